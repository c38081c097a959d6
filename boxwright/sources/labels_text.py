"""Label text files: one file per image, one object per line; validation rules and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.session import materialize

# Image suffixes that a manifest keeps.
IMAGE_SUFFIXES = ("avif", "bmp", "dng", "heic", "heif", "jp2", "jpeg", "jpeg2000", "jpg", "mpo", "png", "tif", "tiff", "webp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) rows of every text file below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).selectExpr(
        "_metadata.file_path as path", "value as line"
    )


def image_suffix_test(column: str = "path") -> str:
    return f"lower(element_at(split({column}, '[.]'), -1)) in ({', '.join(repr(s) for s in IMAGE_SUFFIXES)})"


def label_path(column: str = "path") -> str:
    """Label file of an image: the last /images/ becomes /labels/, the suffix becomes .txt."""
    return f"regexp_replace(regexp_replace({column}, '^(.*)/images/', '$1/labels/'), '[.][^./]*$', '.txt')"


def parse_lines(lines: DataFrame, pose: bool = False) -> DataFrame:
    """Objects of label files: cls, centre box, polygon points.

    One line with more than six tokens turns every line of its file into a polygon (unless the task is pose);
    the flag is aggregated per file and joined back, so a hot file is not one window.
    """
    split = r"split(trim(line), '\\s+')"
    # A generated row is split once: the filter on blank lines stays above it instead of repeating the line's expression.
    filled = lines.selectExpr("path", f"explode(array({split})) as t").where("t[0] <> '' or size(t) > 1")
    # Numbers are parsed below the join, so later expressions read an attribute instead of parsing again.
    tokens = filled.selectExpr("path", "transform(t, s -> cast(s as double)) as v")
    if pose:
        flagged = tokens.selectExpr("*", "false as is_polygon")
    else:
        flags = filled.groupBy("path").agg(F.expr("max(size(t)) > 6 as is_polygon"))
        flagged = tokens.join(flags, "path")
    shaped = flagged.selectExpr(
        "path", "v", "is_polygon",
        "if(is_polygon, filter(v, (c, i) -> i % 2 = 1), null) as _xs", "if(is_polygon, filter(v, (c, i) -> i > 0 and i % 2 = 0), null) as _ys",
    )
    return shaped.selectExpr(
        "path", "v", "is_polygon", "cast(v[0] as int) as cls", "zip_with(_xs, _ys, (a, b) -> struct(a as x, b as y)) as polygon",
        "if(is_polygon, (array_min(_xs) + array_max(_xs)) / 2, v[1]) as x", "if(is_polygon, (array_min(_ys) + array_max(_ys)) / 2, v[2]) as y",
        "if(is_polygon, array_max(_xs) - array_min(_xs), v[3]) as w", "if(is_polygon, array_max(_ys) - array_min(_ys), v[4]) as h",
    )


def keypoints(v: str, count: int, dims: int) -> str:
    """Keypoint structs after five box numbers; two-number points get visibility 0 when negative, else 1."""
    vis = f"{v}[5 + i * {dims} + 2]" if dims == 3 else f"if({v}[5 + i * 2] < 0 or {v}[6 + i * 2] < 0, 0D, 1D)"
    return f"transform(sequence(0, {count - 1}), i -> struct({v}[5 + i * {dims}] as x, {v}[6 + i * {dims}] as y, {vis} as v))"


def verdicts(objects: DataFrame, num_classes: int, pose_columns: int | None = None) -> DataFrame:
    """One row per file: first broken rule (null when clean), object and duplicate counts.

    Rules look at the first five numbers of box files and at the coordinates of polygon files.
    """
    coords = "if(is_polygon, concat(array(x, y, w, h), polygon.x, polygon.y), slice(v, 2, size(v) - 1))"
    width = f"size(v) = {pose_columns}" if pose_columns else "(is_polygon or size(v) = 5)"
    rules = objects.selectExpr(
        "path", "cls", "x", "y", "w", "h", f"not ({width}) as bad_columns",
        f"array_max({coords}) > 1.01D as too_large", f"array_min({coords}) < -0.01D or cls < 0 as negative", f"cls >= {num_classes} as bad_class",
    )
    per_row = rules.groupBy("path", "cls", "x", "y", "w", "h").agg(
        F.expr("count(*) as n"), *[F.expr(f"bool_or({c}) as {c}") for c in ("bad_columns", "too_large", "negative", "bad_class")]
    )
    return per_row.groupBy("path").agg(
        F.expr("sum(n) as n_objects"), F.expr("sum(n) - count(*) as n_duplicates"),
        F.expr("""case when bool_or(bad_columns) then 'columns' when bool_or(too_large) then 'out of bounds'
            when bool_or(negative) then 'negative' when bool_or(bad_class) then 'class' end as reason"""),
    )


def clean_objects(objects: DataFrame, verdict: DataFrame) -> DataFrame:
    """Objects of valid files, duplicate rows removed."""
    good = verdict.where("reason is null").select("path")
    rows = objects.join(good, "path", "left_semi")
    return rows.dropDuplicates(["path", "cls", "x", "y", "w", "h"])


def scan_report(images: DataFrame, files: DataFrame, verdict: DataFrame) -> DataFrame:
    """Found / missing / empty / corrupt per image; ``images`` and ``files`` hold label paths, files may be empty."""
    joined = images.join(files.selectExpr("path", "true as present"), "path", "left").join(verdict, "path", "left")
    return joined.selectExpr(
        "*",
        "case when present is null then 'missing' when n_objects is null then 'empty' when reason is not null then 'corrupt' else 'found' end as status",
    )


def read_manifest(spark: SparkSession, path: str, fraction: float = 1.0) -> DataFrame:
    """Image paths from a folder or a manifest text file, sorted rank kept, optional leading fraction.

    Manifest lines that start with ./ are relative to the manifest's folder.
    """
    if path.endswith(".txt"):
        parent = path.rsplit("/", 1)[0]
        raw = spark.read.text(path).selectExpr(f"if(value like './%', concat('{parent}', substring(value, 2)), value) as path")
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    kept = raw.where(image_suffix_test())
    if fraction >= 1.0:
        return kept
    return leading_share(kept, fraction)


def leading_share(paths: DataFrame, fraction: float) -> DataFrame:
    """The first ``fraction`` of the rows (column path) in path order, the count rounded half to even.

    Paths are dealt by range and written once; the row counts of the ranges locate the one the share ends in, and only
    that range is ranked.
    """
    dealt = materialize(paths.select("path").repartitionByRange("path").withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.expr("count(*) as _n"))
    # One row per shuffle partition.
    spans = F.broadcast(counts.selectExpr("_range", "_n", "sum(_n) over (order by _range) - _n as _before", f"cast(bround(sum(_n) over () * {fraction}D, 0) as bigint) as _quota"))
    placed = dealt.join(spans, "_range")
    sure = placed.where("_before + _n <= _quota").select("path")
    edge = placed.where("_before < _quota and _before + _n > _quota").selectExpr("path", "_before + row_number() over (partition by _range order by path) <= _quota as _in")
    return sure.union(edge.where("_in").select("path"))
