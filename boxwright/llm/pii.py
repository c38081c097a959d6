"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans are regular expressions with checks (address parts, digit counts, Luhn). They are the seeds of the bootstrap:
the one to three words before and behind a seed are its lexical patterns. Candidates are other identifier-like runs in the same
places: tokens with digits, groups of digits, addresses that are spelt out. Patterns and instances form a graph whose scores are iterated: a pattern is as
good as the instances it extracts, an instance as good as the patterns that extract it (seeds stay at 1). What high-confidence
patterns extract and the base patterns miss is added under the kind of the pattern's seeds.

Only DataFrame operations are used; regular expressions are written so that no match can recurse or backtrack over long
runs. The graph is summed to distinct (pattern, instance) rows before it is joined. A pattern must be specific: half of the places
of its words hold an identifier, which is counted over all texts, so that common words are no pattern. Accepted patterns are a table
that is joined to the places.

Defined results: null and empty texts have no spans; repeated rows have the same spans; equal spans come once per kind; an
empty table gives an empty result; further columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.text import GAP, body
from boxwright.session import materialize

WORD = 64  # characters of a pattern's word
BITS = 1 << 14  # 64-bit words of the bitmap of pattern words
KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and look-behinds keep the leftmost matches of the plain forms without their backtracking: a start
# inside a run can only match where the run's first place does, or right behind the match before (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def matches(df: DataFrame, kind: str, pattern: str, need: str, text: str = "_text") -> DataFrame:
    """Adds ``_<kind>``: array of struct(s, e, m) of all matches, left to right."""
    able = F.col(text).rlike(need)
    none = F.lit(None).cast("array<string>")
    found = F.when(able, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(able, F.split(F.col(text), pattern, -1)).otherwise(none)
    df = df.withColumn("_m", found).withColumn("_g", F.when(F.size("_m") > 0, gaps))
    # running places: a fold that carries the end of the last match
    fold = """case when size(_m) > 0 then aggregate(
        sequence(0, size(_m) - 1),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
        (acc, i) -> named_struct(
            'at', acc.at + length(_g[i]) + length(_m[i]),
            'out', concat(acc.out, array(named_struct('s', acc.at + length(_g[i]), 'e', acc.at + length(_g[i]) + length(_m[i]), 'm', _m[i])))),
        acc -> acc.out) else cast(array() as array<struct<s:int,e:int,m:string>>) end"""
    return df.withColumn(f"_{kind}", F.expr(fold)).drop("_m", "_g")


LUHN = """aggregate(sequence(1, length({d})), 0, (sum, i) -> sum
    + case when i % 2 = 1 then cast(substring({d}, -i, 1) as int)
           when cast(substring({d}, -i, 1) as int) < 5 then 2 * cast(substring({d}, -i, 1) as int)
           else 2 * cast(substring({d}, -i, 1) as int) - 9 end) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and (ltrim('0', p) = '' or cast(ltrim('0', p) as int) <= 255))",
    "card": "length(translate(x.m, ' -', '')) between 14 and 19 and " + LUHN.format(d="translate(x.m, ' -', '')"),
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15",
}


def base_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """Documents with ``base``: array of struct(s, k, e, m) by start, then kind as listed; k is the kind's number."""
    df = docs.withColumn("_text", body(F.col(column)))
    for kind in KINDS:
        df = matches(df, kind, PATTERNS[kind], NEED[kind])
    lists = ", ".join(
        f"transform(filter(_{kind}, x -> {CHECKS[kind]}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'm', x.m))" for k, kind in enumerate(KINDS)
    )
    return df.withColumn("base", F.expr(f"array_sort(concat({lists}))")).drop("_text", *[f"_{k}" for k in KINDS])


REACH = 3 * (WORD + 2)  # characters beside a place that can hold its patterns


def _contexts(text: str, s: str, e: str) -> str:
    """Patterns of a place: the one, two and three words before it and those behind it, lower-cased, with marks.

    Words have up to ``WORD`` characters. What the reach cuts is no whole word and left out.
    """
    cut = r"filter(split(lower({t}), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    before = cut.format(t=f"substring({text}, greatest(1, {s} - {REACH - 1}), least({REACH}, {s}))")
    behind = cut.format(t=f"substring({text}, {e} + 1, {REACH})")
    whole_before = f"transform(array({before}), w -> if({s} > {REACH} and size(w) > 0, slice(w, 2, size(w)), w))[0]"
    whole_behind = f"transform(array({behind}), w -> if({e} + {REACH} < length({text}) and size(w) > 0, slice(w, 1, size(w) - 1), w))[0]"
    last = lambda n: f"if(size(w) >= {n}, array(concat('<', array_join(slice(w, -{n}, {n}), ' '))), array())"
    first = lambda n: f"if(size(w) >= {n}, array(concat('>', array_join(slice(w, 1, {n}), ' '))), array())"
    sides = [f"transform(array({w}), w -> concat({', '.join(f(n) for n in (1, 2, 3))}))[0]" for w, f in ((whole_before, last), (whole_behind, first))]
    return f"filter(concat({', '.join(sides)}), p -> length(p) <= {REACH} and not exists(split(p, ' '), w -> length(w) > {WORD + 1}))"


# Identifier-like runs: a token with digits, groups of digits, an e-mail address that is spelt out.
LIKE = {
    "token": (r"(?<![A-Za-z0-9@._+-])(?:[A-Za-z@_+-]*+[0-9.]){5}[A-Za-z0-9@._+-]*+", r"[0-9]{2}", "length(x.m) >= 6 and length(regexp_replace(x.m, '[^0-9]', '')) >= 5"),
    "group": (r"(?<![0-9])[(]?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++", r"[0-9][\x20().-]{1,2}[0-9]", "length(regexp_replace(x.m, '[^0-9]', '')) >= 7"),
    "spelt": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[][aA][tT][)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[][dD][oO][tT][)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
        r"[aA][tT][)\]\x20]", "true",
    ),
}


def with_contexts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``_seen``: array of struct(s, e, m, k, patterns) of base spans (k their kind) and identifier-like runs (k = -1) that touch no
    base span; of runs that touch the longer kind counts."""
    df = docs.withColumn("_text", body(F.col(column)))
    for name, (pattern, need, _) in LIKE.items():
        df = matches(df, name, pattern, need)
    apart = "not exists(base, b -> b.s < x.e and x.s < b.e)"
    spelt = f"filter(_spelt, x -> {apart})"
    group = f"filter(_group, x -> {LIKE['group'][2]} and {apart} and not exists(_spelt, b -> b.s < x.e and x.s < b.e))"
    token = f"filter(_token, x -> {LIKE['token'][2]} and {apart} and not exists(_spelt, b -> b.s < x.e and x.s < b.e) and not exists(_runs, b -> b.s < x.e and x.s < b.e))"
    df = df.withColumn("_runs", F.expr(group)).withColumn("_like", F.expr(f"concat({spelt}, _runs, {token})"))
    shape = f"named_struct('s', x.s, 'e', x.e, 'm', x.m, 'k', {{k}}, 'patterns', {_contexts('_text', 'x.s', 'x.e')})"
    seen = f"concat(transform(base, x -> {shape.format(k='x.k')}), transform(_like, x -> {shape.format(k='-1')}))"
    return df.withColumn("_seen", F.expr(seen)).drop("_text", "_runs", "_like", *[f"_{name}" for name in LIKE])


def scored_patterns(seen: DataFrame, rounds: int = 3, prior: float = 4.0) -> DataFrame:
    """(pattern, kind, support, confidence) from the places ``_seen``, by iterated scores over the pattern-instance graph.

    A pattern's score is the mean score of its distinct instances, shrunk by ``prior`` unknown ones of score 0. An
    instance that is no seed gets the noisy-or of its patterns' scores. Rounds write the small graph's scores out.
    """
    places = seen.select(F.explode("_seen").alias("x")).selectExpr("x.m as instance", "x.k as k", "explode(x.patterns) as pattern")
    edges = materialize(places.groupBy("pattern", "instance").agg(F.max("k").alias("k"), F.count("*").alias("n")))
    scores = edges.select("instance", F.when(F.col("k") >= 0, 1.0).otherwise(0.0).alias("score"), "k").distinct().groupBy("instance").agg(F.max("score").alias("score"), F.max("k").alias("k"))
    for _ in range(rounds):
        by_pattern = edges.join(scores.select("instance", "score"), "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("confidence"))
        by_instance = edges.where("k < 0").join(by_pattern, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("found")
        )
        scores = materialize(scores.join(by_instance, "instance", "left").select("instance", "k", F.when(F.col("k") >= 0, 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score")))
    final = edges.join(scores.select("instance", "score"), "instance").groupBy("pattern").agg(
        (F.sum("score") / (F.count("*") + prior)).alias("confidence"), F.sum(F.when(F.col("k") >= 0, F.col("n")).otherwise(0)).alias("support"),
        F.sum("n").alias("places"),
        F.count(F.when(F.col("k") >= 0, 1)).alias("seeds"), *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(len(KINDS))],
    )
    most = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{k}") == most, k) for k in range(len(KINDS))])
    return final.select("pattern", kind.alias("k"), "support", "places", "seeds", "confidence")


def specific(docs: DataFrame, patterns: DataFrame, column: str, least: float) -> DataFrame:
    """Patterns (pattern, places, ...) of which at least the share ``least`` of all places, those of any other words included, hold an
    identifier. Their words are counted over all texts; a bitmap of fixed size drops most other words before they are summed."""
    wanted = patterns.select(F.expr("substring(pattern, 2)").alias("w"), "pattern", "places").withColumn("h", F.xxhash64("w"))
    place = F.expr(f"cast(shiftrightunsigned(h, 6) & {BITS - 1}L as int)").alias("at")
    marked = dict(wanted.groupBy(place).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("bits")).collect())
    bitmap = docs.sparkSession.createDataFrame([([marked.get(i, 0) for i in range(BITS)],)], "bits array<long>")
    words = F.filter(F.split(F.lower(body(F.col(column))), GAP), lambda w: w != "")

    def runs(n: int) -> F.Column:
        made = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return F.when(F.size("_w") >= n, made).otherwise(F.array().cast("array<string>"))

    cut = docs.select(words.alias("_w")).select(F.explode(F.flatten(F.array(*[runs(n) for n in (1, 2, 3)]))).alias("w")).withColumn("h", F.xxhash64("w"))
    # the bitmap is one row of fixed size
    hit = F.expr(f"get(bits, cast(shiftrightunsigned(h, 6) & {BITS - 1}L as int)) & shiftleft(1L, cast(h & 63L as int)) <> 0")
    totals = cut.join(F.broadcast(bitmap), hit, "left_semi").groupBy("w").agg(F.count("*").alias("total"))
    kept = wanted.join(totals, "w", "left").where(F.col("places") >= least * F.coalesce("total", F.lit(0))).select("pattern")
    return patterns.join(kept, "pattern", "left_semi")


def find(
    docs: DataFrame, column: str = "text", keep: Sequence[str] | None = None, confidence: float = 0.75, min_seeds: int = 8, least: float = 0.5,
) -> DataFrame:
    """Documents with ``base`` and ``spans``, arrays of struct(s, k, e, m); spans hold the base and what patterns add.

    ``keep`` names the columns to carry (all by default); the text is written along with its spans only if it is one of them. Columns
    named base or spans are replaced; any other names are free. Accepted patterns are a table, of any size: a pattern needs ``min_seeds`` distinct
    seeds, whatever their share of all.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("_keep")
    texts = docs.select(kept, F.col(f"`{column}`").alias("_t"))
    placed = with_contexts(base_spans(texts, "_t"), "_t").select("_keep", "base", "_seen").withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(placed)
    patterns = scored_patterns(placed.select("_seen"))
    good = materialize(patterns.where((F.col("confidence") >= confidence) & (F.col("seeds") >= min_seeds)))
    columns = [F.col(f"_keep.`{c}`").alias(c) for c in names]
    if good.isEmpty():
        return placed.select(*columns, "base", F.col("base").alias("spans"))
    accepted = materialize(specific(texts, good, "_t", least).select("pattern", F.col("k").alias("kind"), "confidence"))
    like = placed.select("_row", F.explode(F.filter("_seen", lambda x: x["k"] < 0)).alias("x")).select("_row", "x.s", "x.e", "x.m", F.explode("x.patterns").alias("pattern"))
    found = like.join(accepted, "pattern").groupBy("_row", "s", "e", "m").agg(F.expr("max_by(kind, struct(confidence, pattern))").alias("k"))
    added = found.groupBy("_row").agg(F.collect_list(F.struct("s", "k", "e", "m")).alias("_added"))
    whole = placed.join(added, "_row", "left")
    spans = F.when(F.col("_added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("_added", F.array().cast(added.schema["_added"].dataType)))))
    return whole.select(*columns, "base", spans.alias("spans"))


def digest(spans: str) -> F.Column:
    """kind:start:end of all spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')")


def redacted(text: str = "text", spans: str = "spans") -> F.Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"""case when size({spans}) > 0 then aggregate(
        {spans}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.e <= acc.at, acc, named_struct(
            'at', x.e,
            'out', concat(acc.out, array(substring({text}, acc.at + 1, greatest(0, x.s - acc.at)), if(x.s < acc.at, '', concat('[', {names}[x.k], ']')))))),
        acc -> concat(array_join(acc.out, ''), substring({text}, acc.at + 1, length({text})))) else {text} end""")
