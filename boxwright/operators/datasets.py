"""Dataset statistics, splits, profiles and benchmark rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.scans import blocked_scan


def draw(key: str, seed: int = 0) -> str:
    """Uniform number in [0, 1) from an integer key: an arithmetic hash, the same in any engine."""
    return f"(pmod(pmod({key}, 1000003L) * 7919 + {seed} * 104729 + pmod({key}, 8191L) * 131071, 1000000L) / 1000000D)"


def statistics(objects: DataFrame, images: DataFrame, classes: DataFrame) -> DataFrame:
    """Per split and class: instances and images, zero-filled, next to split totals and unlabelled images."""
    per = objects.groupBy("split", "cls").agg(F.expr("count(*) as instances"), F.expr("count(distinct image_id) as images"))
    labelled = objects.groupBy("split").agg(F.expr("count(distinct image_id) as labelled"))
    totals = images.groupBy("split").agg(F.expr("count(*) as total"))
    # Splits times classes: both are small dimensions.
    frame = totals.join(labelled, "split", "left").crossJoin(F.broadcast(classes))
    return frame.join(per, ["split", "cls"], "left").selectExpr(
        "split", "cls", "coalesce(instances, 0) as instances", "coalesce(images, 0) as images", "total",
        "total - coalesce(labelled, 0) as unlabelled",
    )


def statistics_json(stats: DataFrame) -> DataFrame:
    """Nested JSON text per split; the array is as long as the class list."""
    return stats.groupBy("split").agg(
        F.expr("sum(instances) as instances"), F.expr("first(total) as total"), F.expr("first(unlabelled) as unlabelled"),
        F.expr("transform(array_sort(collect_list(struct(cls, instances, images))), s -> struct(s.instances, s.images)) as c"),
    ).selectExpr("split", """to_json(struct(struct(instances as total, c.instances as per_class) as instance_stats,
        struct(total, unlabelled, c.images as per_class) as image_stats)) as stats""")


def weighted_split(files: DataFrame, key: str, weights=(0.9, 0.1, 0.0), seed: int = 0) -> DataFrame:
    """Independent draw per file; the distribution is what matters, not a generator's stream."""
    return files.selectExpr("*", f"{draw(key, seed)} as _u").selectExpr(
        *files.columns, f"case when _u < {weights[0]}D then 'train' when _u < {weights[0] + weights[1]!r}D then 'val' else 'test' end as split"
    )


def ranked_quota(df: DataFrame, part: str, key: str, quota: str, seed: int = 0, buckets: int = 1000, order: str | None = None) -> DataFrame:
    """Mark the first ``quota(n)`` rows of each group in hash order (or in ``order``, a number in [0, 1)), exactly,
    without ranking whole groups.

    Rows fall into ordered buckets; the counts of the buckets locate the one the quota ends in, and only
    that bucket is ranked.
    """
    hashed = df.selectExpr("*", f"{order or draw(key, seed)} as _u").selectExpr("*", f"cast(floor(_u * {buckets}) as int) as _b")
    counts = hashed.groupBy(part, "_b").agg(F.expr("count(*) as _n"))
    spans = counts.selectExpr(
        part, "_b", "sum(_n) over (partition by {0} order by _b) - _n as _before".format(part), "_n as _size",
        f"sum(_n) over (partition by {part}) as n",
    ).selectExpr(part, "_b", "_before", "_size", f"{quota} as _q")
    placed = hashed.join(spans, [part, "_b"])
    sure = placed.where("_before + _size <= _q or _before >= _q").selectExpr(*df.columns, "_before + _size <= _q as picked")
    edge = placed.where("_before + _size > _q and _before < _q").selectExpr(
        "*", f"row_number() over (partition by {part}, _b order by _u, {key}) + _before <= _q as picked"
    ).select(*df.columns, "picked")
    return sure.unionByName(edge)


def fold_of(key: str, k: int, seed: int = 0) -> str:
    """Fold number 0..k-1 of a row; every row is validation in exactly one fold."""
    return f"cast(floor({draw(key, seed)} * {k}) as int)"


def sigma_clip(df: DataFrame, part: str, value: str, sigma: float = 2.0, rounds: int = 3) -> DataFrame:
    """Drop values outside mean +- sigma deviations, up to three times; bounds are aggregated, not windowed."""
    for _ in range(rounds):
        bounds = df.groupBy(part).agg(F.expr(f"avg({value}) as _m"), F.expr(f"stddev_pop({value}) as _s"))
        df = df.join(bounds, part).where(f"_s = 0 or abs({value} - _m) < {sigma}D * _s").drop("_m", "_s")
    return df


def category_frequency(names: DataFrame) -> DataFrame:
    """Instances per synonym; a class name lists synonyms with '/'. Input (name, n)."""
    return names.selectExpr("explode(split(name, '/')) as name", "n").selectExpr("trim(name) as name", "n").groupBy("name").agg(F.expr("sum(n) as n"))


def negative_names(freq: DataFrame, floor: int = 100) -> DataFrame:
    """Names at least as frequent as min(maximum, floor); one-row broadcast of the maximum."""
    top = F.broadcast(freq.agg(F.expr(f"least(max(n), {floor}) as _t")))
    return freq.join(top, F.expr("n >= _t")).drop("_t")


def grid_histogram(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Two-dimensional histogram over the value range of each axis."""
    span = F.broadcast(df.agg(*[F.expr(f"{f}({c}) as {f}_{n}") for n, c in (("x", x), ("y", y)) for f in ("min", "max")]))

    def cell(v: str, n: str) -> str:
        return f"least(cast(floor(({v} - min_{n}) / (max_{n} - min_{n}) * {bins}) as int), {bins - 1})"

    return df.crossJoin(span).groupBy(F.expr(f"{cell(x, 'x')} as bx"), F.expr(f"{cell(y, 'y')} as by")).agg(F.expr("count(*) as n"))


def keypoint_shape(rows: DataFrame, column: str = "values", offset: int = 0, strict: bool = False) -> DataFrame:
    """Infer [points, dims] from all flat keypoint lists; null when they disagree or do not fit, an error if ``strict``.

    ``offset`` numbers stand before the keypoints (5 in a label line: class and box).
    """
    lists = rows.selectExpr(f"slice({column}, {offset + 1}, greatest(size({column}) - {offset}, 0)) as _k")
    found = lists.agg(
        F.expr("if(count(distinct size(_k)) = 1, max(size(_k)), null) as len"),
        F.expr("bool_and(forall(transform(_k, (v, i) -> if(i % 3 = 2, v, 0D)), v -> v in (0, 1, 2))) as flags"),
    ).selectExpr(
        "case when len > 0 and len % 3 = 0 and flags then cast(len / 3 as int) when len % 3 <> 0 and len % 2 = 0 then cast(len / 2 as int) end as points",
        "case when len > 0 and len % 3 = 0 and flags then 3 when len % 3 <> 0 and len % 2 = 0 then 2 end as dims",
    )
    error = "raise_error('keypoint lists do not share one shape of two or three numbers a point')"
    return found.selectExpr(*[f"coalesce({c}, {error}) as {c}" for c in ("points", "dims")]) if strict else found


def population_stability(train: DataFrame, live: DataFrame, bucket: str) -> DataFrame:
    """Share per bucket on both sides and the stability index term; the sum of terms is the index."""
    def share(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.expr(f"{bucket} as bucket")).agg(F.expr("count(*) as n"))
        total = F.broadcast(counts.agg(F.expr("sum(n) as t")))
        return counts.crossJoin(total).selectExpr("bucket", f"n / t as {name}")

    both = share(train, "p").join(share(live, "q"), "bucket", "full_outer")
    return both.selectExpr("bucket", "coalesce(p, 0D) as p", "coalesce(q, 0D) as q").selectExpr(
        "*", "(q - p) * ln((q + 1e-6D) / (p + 1e-6D)) as term"
    )


def rect_batches(images: DataFrame, batch: int, stride: int = 32, size: int = 640, pad: float = 0.5) -> DataFrame:
    """Batches of similar aspect ratio: rank by height over width, one canvas per batch.

    The global rank is (images before the ratio bucket) + (rank inside the bucket), so no single task sorts all.
    """
    ratio = images.selectExpr("image_id", "height / width as ar").selectExpr("*", "cast(floor(ar * 1000) as bigint) as _b", "image_id % 64 as _s")
    counts = ratio.groupBy("_b", "ar", "_s").agg(F.expr("count(*) as _n"))
    per_ratio = counts.groupBy("_b").agg(F.expr("sum(_n) as _t"))
    # Ratio buckets are bounded by the range of aspect ratios.
    starts = per_ratio.selectExpr("_b", "sum(_t) over (order by _b) - _t as _before")
    inner = counts.selectExpr("_b", "ar", "_s", "sum(_n) over (partition by _b order by ar, _s) - _n as _inside")
    ranked = ratio.selectExpr("*", "row_number() over (partition by _b, ar, _s order by image_id) - 1 as _r").join(
        inner, ["_b", "ar", "_s"]
    ).join(starts, "_b").selectExpr("image_id", "ar", f"cast((_before + _inside + _r) div {batch} as bigint) as batch")
    shapes = ranked.groupBy("batch").agg(F.expr("min(ar) as lo"), F.expr("max(ar) as hi")).selectExpr(
        "batch", "case when hi < 1 then hi else 1D end as sh", "case when lo > 1 then 1 / lo else 1D end as sw"
    ).selectExpr(
        "batch", f"cast(ceil(sh * {size} / {stride} + {pad}D) * {stride} as int) as height",
        f"cast(ceil(sw * {size} / {stride} + {pad}D) * {stride} as int) as width",
    )
    return ranked.join(shapes, "batch")


def ks_statistic(train: DataFrame, live: DataFrame, value: str, blocks: int = 4096) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, exact: the largest distance of the two running shares over all distinct values.

    Values are counted before they are ordered, and the running counts are taken inside ordered blocks, whose totals are carried across.
    """
    both = train.selectExpr(f"cast({value} as double) as v", "1L as a", "0L as b").union(live.selectExpr(f"cast({value} as double) as v", "0L as a", "1L as b"))
    counts = both.where("v is not null and not isnan(v)").groupBy("v").agg(F.expr("sum(a) as a"), F.expr("sum(b) as b"))
    ends = counts.agg(F.expr("min(v) as lo"), F.expr("max(v) as hi"), F.expr("sum(a) as n_a"), F.expr("sum(b) as n_b"))
    # one row, so the cross join adds four columns
    ordered = counts.crossJoin(F.broadcast(ends)).selectExpr("*", "1 as one", f"cast(coalesce(floor(try_divide(v - lo, hi - lo) * {blocks}), 0) as bigint) as block")
    run = blocked_scan(ordered, ["one"], ["v"], "block", sums={"up_a": "a", "up_b": "b"})
    return run.agg(F.expr("max(abs(up_a / n_a - up_b / n_b)) as ks"), F.expr("max(n_a) as n_train"), F.expr("max(n_b) as n_live"))


def best_epochs(logs: DataFrame, patience: int, block: str) -> DataFrame:
    """Per run (run, step, fitness): the best value, the last epoch that set it, and the first epoch ``patience`` epochs past the best so far.

    One scan numbers the epochs and finds the best before each; only the epochs that set a new best go on from there.
    """
    numbered = blocked_scan(logs, ["run"], ["step"], block, sums={"epoch": "1L"}, tops={"prev": "fitness"})
    marked = numbered.where("prev is null or fitness > prev or prev = 0").select("run", "epoch")
    gaps = blocked_scan(marked, ["run"], ["epoch"], "epoch div 100000", lags={"before": "epoch"})
    found = gaps.groupBy("run").agg(F.expr("max(epoch) as best_epoch"), F.expr(f"min(case when epoch - before > {patience} then before + {patience} end) as gap"))
    whole = logs.groupBy("run").agg(F.expr("count(*) as n"), F.expr("max(fitness) as best"))
    end = f"case when n - best_epoch >= {patience} then best_epoch + {patience} end"
    return whole.join(found, "run").selectExpr("run", f"least(gap, {end}) as stop_epoch", "best_epoch", "best")


def size_slice(area: str, small: float = 1024, medium: float = 9216) -> str:
    """0 small, 1 medium, 2 large by the area of an object in pixels."""
    return f"case when {area} < {small}D then 0 when {area} < {medium}D then 1 else 2 end"


def class_confusion(ranked: DataFrame) -> DataFrame:
    """Cells of matrix[pred][truth] of a classifier, empty ones left out."""
    return ranked.groupBy("pred", "truth").agg(F.expr("count(*) as n"))
