"""String formatting as SQL text, rounding the exact binary value as C and Python do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = "134217729D"


def _error(v: str, s: str, p: str) -> str:
    """Rounding error of the product p = v * s, exact in double arithmetic (split both factors in halves)."""
    vh, sh = f"({_SPLIT} * {v} - ({_SPLIT} * {v} - {v}))", f"({_SPLIT} * {s} - ({_SPLIT} * {s} - {s}))"
    vl, sl = f"({v} - {vh})", f"({s} - {sh})"
    return f"((({vh} * {sh} - {p}) + {vh} * {sl} + {vl} * {sh}) + {vl} * {sl})"


def _nearest(v: str, s: str) -> str:
    """v * s rounded to a whole number; ties of the exact product go to even."""
    p = f"({v} * {s})"
    excess = f"(({p} - floor({p}) - 0.5D) + {_error(v, s, p)})"
    return f"(floor({p}) + case when {excess} > 0 then 1 when {excess} < 0 then 0 else pmod(floor({p}), 2) end)"


def fixed_round(v: str, digits: int) -> str:
    """Round to a number of places as ``%.nf`` does (non-negative and negative values alike)."""
    s = f"{10 ** digits}D"
    return f"(sign({v}) * {_nearest(f'abs({v})', s)} / {s})"


def general_list(values: str) -> str:
    """Format every number of an array with six significant digits, zeros dropped: the C ``%g`` rule."""
    scale = "case " + " ".join(f"when abs(c) >= {10.0 ** e * (1 - 5e-7)!r}D then 1e{5 - e}D" for e in range(5, -5, -1)) + " else 0D end"
    tail = r"\\.?0+$"
    sci = r"regexp_replace(regexp_replace(format_string('%.5e', t.v), '0+e', 'e'), '\\.e', 'e')"
    plain = f"regexp_replace(cast(cast(sign(t.v) * {_nearest('abs(t.v)', 't.s')} / t.s as decimal(24, 10)) as string), '{tail}', '')"
    return (
        f"transform(transform({values}, c -> struct(c as v, {scale} as s)), t -> case when t.v = 0 then '0'"
        f" when t.s = 0 or abs(t.v) >= 999999.5D then {sci} else {plain} end)"
    )


def general_texts(df: DataFrame, values: str, name: str) -> DataFrame:
    """Adds the numbers of an array as text: ``general_list`` joined by spaces.

    Lists of plain numbers are written in batches by C's own rule; one with a null, a NaN or a number that asks for an exponent goes the other way.
    """

    @F.pandas_udf("string")
    def written(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else " ".join(["%g"] * len(r)) % tuple((r + 0.0).tolist()) for r in rows], dtype=object)

    from boxwright.operators.boxes import bound

    listed = bound(df, _values=values)
    odd = "exists(_values, v -> v is null or isnan(v) or abs(v) >= 999999D or (v <> 0 and abs(v) < 0.0002D))"
    plain = written(F.expr(f"if({odd}, null, _values)")).alias("_plain")
    return listed.select("*", plain).selectExpr(*df.columns, f"coalesce(_plain, array_join({general_list('_values')}, ' ')) as {name}")


def general(v: str) -> str:
    return f"{general_list(f'array({v})')}[0]"


def clean_name(v: str) -> str:
    """Keep letters, digits and underscore."""
    return f"regexp_replace({v}, '[^a-zA-Z0-9_]', '_')"


def clean_stream(v: str) -> str:
    """Replace symbols that are unsafe in a stream name."""
    return rf"regexp_replace({v}, '[|@#!¡·$€%&()=?¿^*;:,¨´`><+]', '_')"
