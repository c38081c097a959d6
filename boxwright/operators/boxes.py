"""Projections and filters over box tables (corner columns x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions.text import clean_name


def replace_columns(df: DataFrame, **exprs: str) -> DataFrame:
    """Select all columns, with some replaced by SQL expressions over the old values."""
    new = [f"{e} as {n}" for n, e in exprs.items() if n not in df.columns]
    return df.selectExpr(*[f"{exprs[c]} as {c}" if c in exprs else c for c in df.columns], *new)


def bound(df: DataFrame, **exprs: str) -> DataFrame:
    """``replace_columns``, but each expression is worked out once a row: later steps and filters cannot copy it into every place that uses it."""
    rest = [c for c in df.columns if c not in exprs]
    made = df.selectExpr(*rest, f"inline(array(struct({', '.join(f'{e} as {n}' for n, e in exprs.items())})))")
    return made.select(*df.columns, *[n for n in exprs if n not in df.columns])


def all_formats(df: DataFrame, width: str, height: str) -> DataFrame:
    """Centre, top-left and normalised centre forms, derived from corners."""
    return df.selectExpr(
        "*", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy", "x2 - x1 as w", "y2 - y1 as h",
        f"(x1 + x2) / 2 / {width} as cxn", f"(y1 + y2) / 2 / {height} as cyn",
        f"(x2 - x1) / {width} as wn", f"(y2 - y1) / {height} as hn",
    )


def from_centre(df: DataFrame, width: str = "1", height: str = "1", names: tuple[str, ...] = ("cx", "cy", "w", "h")) -> DataFrame:
    """Corners from centre forms; with an image size, from normalised ones."""
    cx, cy, w, h = (f"{n} * {size}" if size != "1" else n for n, size in zip(names, (width, height, width, height)))
    return replace_columns(df, x1=f"{cx} - {w} / 2", y1=f"{cy} - {h} / 2", x2=f"{cx} + {w} / 2", y2=f"{cy} + {h} / 2")


def from_top_left(df: DataFrame, names: tuple[str, ...] = ("left", "top", "w", "h")) -> DataFrame:
    """Corners from the top-left corner and the size."""
    left, top, w, h = names
    return replace_columns(df, x1=left, y1=top, x2=f"{left} + {w}", y2=f"{top} + {h}")


def centre_to_top_left(df: DataFrame) -> DataFrame:
    """Top-left corner and size from the centre form."""
    return df.selectExpr("*", "cx - w / 2 as left", "cy - h / 2 as top")


def clip(df: DataFrame, width: str, height: str) -> DataFrame:
    return replace_columns(
        df, x1=G.clamp("x1", "0D", width), x2=G.clamp("x2", "0D", width), y1=G.clamp("y1", "0D", height), y2=G.clamp("y2", "0D", height)
    )


def from_corners(df: DataFrame) -> DataFrame:
    """Rotated box (w >= h, angle in [-pi/4, 3pi/4)) from eight ordered corner columns px1, py1 .. px4, py4."""
    edges = df.selectExpr(
        "*", "(px1 + px3) / 2 as cx", "(py1 + py3) / 2 as cy",
        "sqrt(pow(px2 - px1, 2) + pow(py2 - py1, 2)) as _a", "sqrt(pow(px3 - px2, 2) + pow(py3 - py2, 2)) as _b",
    ).selectExpr("*", "if(_a >= _b, atan2(py2 - py1, px2 - px1), atan2(py3 - py2, px3 - px2)) as _t")
    return edges.selectExpr(
        *df.columns, "cx", "cy", "greatest(_a, _b) as w", "least(_a, _b) as h",
        "_t - pi() * floor((_t + pi() / 4) / pi()) as r",
    )


def letterbox_map(df: DataFrame, w0: str, h0: str, w1: float, h1: float, scale_up: bool = True) -> DataFrame:
    """Source pixels to canvas pixels."""
    gain, _, _ = G.letterbox(w0, h0, w1, h1)
    gain = gain if scale_up else f"least({gain}, 1D)"
    px, py = f"rint(({w1}D - rint({w0} * {gain})) / 2 - 0.1D)", f"rint(({h1}D - rint({h0} * {gain})) / 2 - 0.1D)"
    return replace_columns(
        df, x1=f"x1 * {gain} + {px}", x2=f"x2 * {gain} + {px}", y1=f"y1 * {gain} + {py}", y2=f"y2 * {gain} + {py}"
    )


def letterbox_unmap(df: DataFrame, w0: str, h0: str, w1: float, h1: float) -> DataFrame:
    """Canvas pixels back to source pixels, clipped to the image."""
    gain, px, py = G.letterbox(w0, h0, w1, h1)
    back = {c: f"({c} - {p}) / {gain}" for c, p in (("x1", px), ("x2", px), ("y1", py), ("y2", py))}
    return clip(replace_columns(df, **back), w0, h0)


def point_unmap(x: str, y: str, w0: str, h0: str, w1: float, h1: float) -> tuple[str, str]:
    """Keypoints use the unrounded pad."""
    gain, _, _ = G.letterbox(w0, h0, w1, h1)
    fx = G.clamp(f"(({x}) - ({w1}D - rint({w0} * {gain})) / 2) / {gain}", "0D", w0)
    fy = G.clamp(f"(({y}) - ({h1}D - rint({h0} * {gain})) / 2) / {gain}", "0D", h0)
    return fx, fy


def candidates(df: DataFrame, old: str = "o_", min_side: float = 2, min_area: float = 0.1, max_aspect: float = 100) -> DataFrame:
    """Boxes that survive a transform: sides, area ratio to the old box, aspect."""
    w, h = "(x2 - x1)", "(y2 - y1)"
    return df.where(
        f"{w} > {min_side} and {h} > {min_side} and {w} * {h} / ({G.area(old)} + 1e-16D) > {min_area}D"
        f" and greatest({w} / ({h} + 1e-16D), {h} / ({w} + 1e-16D)) < {max_aspect}"
    )


def border_snap(df: DataFrame, width: str, height: str, margin: float = 20, full: float = 0.9) -> DataFrame:
    """Edges near the border move onto it; a box that then overlaps the frame by more than ``full`` becomes it."""
    snapped = replace_columns(
        df, x1=f"if(x1 < {margin}, 0D, x1)", y1=f"if(y1 < {margin}, 0D, y1)",
        x2=f"if(x2 > {width} - {margin}, cast({width} as double), x2)", y2=f"if(y2 > {height} - {margin}, cast({height} as double), y2)",
    ).selectExpr("*", "0D as f_x1", "0D as f_y1", f"cast({width} as double) as f_x2", f"cast({height} as double) as f_y2")
    whole = f"{G.iou('', 'f_')} > {full}D"
    return replace_columns(snapped, **{c: f"if({whole}, f_{c}, {c})" for c in G.CORNERS}).drop(*[f"f_{c}" for c in G.CORNERS])


def near_tile_edge(tile: str = "t_", image: str = "i_", margin: float = 20) -> str:
    """Whether any side lies on a tile edge that is not also the image edge."""
    return "(" + " or ".join(
        f"(abs({c} - {tile}{c}) <= {margin} and not abs({c} - {image}{c}) <= {margin})" for c in G.CORNERS
    ) + ")"


def crop_rectangle(df: DataFrame, width: str, height: str, gain: float = 1.02, pad: float = 10, square: bool = False) -> DataFrame:
    """Integer crop rectangle: scaled side plus pad, truncated, clipped."""
    w, h = "(x2 - x1)", "(y2 - y1)"
    w, h = (f"greatest({w}, {h})",) * 2 if square else (w, h)
    side = {"w": f"({w} * {gain}D + {pad}D)", "h": f"({h} * {gain}D + {pad}D)"}
    return df.selectExpr(
        "*",
        f"cast({G.clamp(f'cast((x1 + x2) / 2 - {side['w']} / 2 as bigint)', '0L', width)} as bigint) as crop_x1",
        f"cast({G.clamp(f'cast((y1 + y2) / 2 - {side['h']} / 2 as bigint)', '0L', height)} as bigint) as crop_y1",
        f"cast({G.clamp(f'cast((x1 + x2) / 2 + {side['w']} / 2 as bigint)', '0L', width)} as bigint) as crop_x2",
        f"cast({G.clamp(f'cast((y1 + y2) / 2 + {side['h']} / 2 as bigint)', '0L', height)} as bigint) as crop_y2",
    )


def unique_clean_names(names: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """Cleaned class names, made unique without regard to case by a running suffix.

    A name dimension is small by nature; the window still runs per cleaned name.
    """
    cleaned = names.selectExpr("*", f"{clean_name(name)} as _clean")
    rank = f"row_number() over (partition by lower(_clean) order by {order}) - 1"
    return cleaned.selectExpr(*names.columns, f"{rank} as _n", "_clean").selectExpr(
        *names.columns, "if(_n = 0, _clean, concat(_clean, '_', _n)) as clean"
    )


def score_rows(df: DataFrame, scores: str, threshold: float, multi_label: bool) -> DataFrame:
    """Best class (strictly above the threshold), or one row per class above it."""
    if multi_label:
        long = df.selectExpr(*[c for c in df.columns if c != scores], f"posexplode({scores}) as (cls, conf)")
    else:
        long = df.selectExpr(
            *[c for c in df.columns if c != scores],
            f"cast(array_position({scores}, array_max({scores})) - 1 as int) as cls", f"array_max({scores}) as conf",
        )
    return long.where(f"conf > {threshold}D")


def keep_classes(df: DataFrame, classes: list[int] | None = None, single: bool = False) -> DataFrame:
    if classes is not None:
        df = df.where(F.col("cls").isin(classes))
    return replace_columns(df, cls="0") if single else df
