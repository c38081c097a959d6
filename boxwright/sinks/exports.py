"""Export projections and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions.text import general_list, general_texts


def box_line(width: str, height: str, conf: bool = False, track: bool = False) -> str:
    """Label line: class, normalised centre box, then confidence and track id when asked for."""
    values = [f"(x1 + x2) / 2 / {width}", f"(y1 + y2) / 2 / {height}", f"(x2 - x1) / {width}", f"(y2 - y1) / {height}"]
    if conf:
        values.append("conf")
    parts = ["cast(cls as string)", f"array_join({general_list(f'array({', '.join(values)})')}, ' ')"]
    if track:
        parts.append("cast(track_id as string)")
    return f"concat_ws(' ', {', '.join(parts)})"


def _line(values: str, conf: bool, track: bool) -> str:
    """Label line of class, numbers, then confidence and track id when asked for."""
    parts = ["cast(cls as string)", f"array_join({general_list(f'concat({values}, array(conf))' if conf else values)}, ' ')"]
    if track:
        parts.append("cast(track_id as string)")
    return f"concat_ws(' ', {', '.join(parts)})"


def polygon_line(points: str = "polygon", width: str = "1", height: str = "1", conf: bool = False, track: bool = False) -> str:
    """Label line: class, then point coordinates as shares of the image."""
    return _line(f"flatten(transform({points}, p -> array(p.x / {width}, p.y / {height})))", conf, track)


def oriented_line(width: str, height: str, conf: bool = False, track: bool = False) -> str:
    """Label line of a rotated box (cx, cy, w, h, r): class, then its four corners as shares of the image."""
    corners = [f"{c} / {height if i % 2 else width}" for i, c in enumerate(G.rotated_corners())]
    return _line(f"array({', '.join(corners)})", conf, track)


def oriented_lines(df: DataFrame, width: str, height: str, conf: bool = False, track: bool = False, name: str = "line") -> DataFrame:
    """``oriented_line`` as a column of a whole table, its numbers written in batches."""
    corners = [f"{c} / {height if i % 2 else width}" for i, c in enumerate(G.rotated_corners())]
    written = general_texts(df, f"array({', '.join([*corners, *(['conf'] if conf else [])])})", "_text")
    parts = ["cast(cls as string)", "_text", *(["cast(track_id as string)"] if track else [])]
    return written.selectExpr(*df.columns, f"concat_ws(' ', {', '.join(parts)}) as {name}")


def pose_line(width: str, height: str, points: str = "kpts", scores: bool = True, conf: bool = False, track: bool = False) -> str:
    """Label line: class, normalised centre box, then x, y and, if they have them, the score of every keypoint."""
    box = f"array((x1 + x2) / 2 / {width}, (y1 + y2) / 2 / {height}, (x2 - x1) / {width}, (y2 - y1) / {height})"
    flat = f"flatten(transform({points}, p -> array(p.x / {width}, p.y / {height}{', p.v' if scores else ''})))"
    return _line(f"concat({box}, {flat})", conf, track)


def class_line(probs: str, names: str) -> str:
    """Classification text: the five best 'probability name' pairs, one per line."""
    pairs = f"transform({probs}, (p, i) -> struct(-p as k, i as i))"
    return f"array_join(transform(slice(array_sort({pairs}), 1, 5), s -> concat(format_string('%.2f', -s.k), ' ', {names}[s.i])), '\\n')"


def write_lines(lines: DataFrame, path: str, partition: str = "split") -> DataFrame:
    """Write text rows (``line``) to one folder per partition value; the files as they read back."""
    lines.select(partition, "line").write.partitionBy(partition).text(path)
    return lines.sparkSession.read.text(path).withColumnRenamed("value", "line")


def write_table(df: DataFrame, path: str, form: str) -> DataFrame:
    """Write rows as csv (nested values as JSON text, with a header) or json; the table as it reads back."""
    flat = nested_to_text(df) if form == "csv" else df
    flat.write.format(form).option("header", True).save(path)
    return df.sparkSession.read.schema(flat.schema).format(form).option("header", True).load(path)


def keypoint_values(points: str = "kpts") -> str:
    """Flat x, y, score list of keypoints, for prediction files."""
    return f"flatten(transform({points}, p -> array(cast(p.x as double), cast(p.y as double), cast(p.v as double))))"


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all run logs under a folder (one folder ``run=...`` each). Lines that do not fit the schema, whose first column counts epochs,
    give no rows."""
    first = schema.split()[0]
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    named = rows.select("*", F.regexp_extract("_metadata.file_path", "run=([^/]+)/", 1).alias("run_id"))
    return named.where(F.col(first).isNotNull())


def summary_rows(det: DataFrame, width: str | None = None, height: str | None = None, decimals: int = 5) -> DataFrame:
    """name, class, confidence and box struct; normalised when a size is given."""
    w, h = width or "1", height or "1"
    box = ", ".join(f"round({c} / {w if c[0] == 'x' else h}, {decimals}) as {c}" for c in G.CORNERS)
    rest = [c for c in det.columns if c not in (*G.CORNERS, "cls", "conf", "name")]
    return det.selectExpr(*rest, "name", "cls as class", f"round(conf, {decimals}) as confidence", f"struct({box}) as box")


def nested_to_text(df: DataFrame) -> DataFrame:
    """CSV writers take no nested values: turn them into JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.selectExpr(*[f"to_json({c}) as {c}" if c in nested else c for c in df.columns])


def prediction_rows(det: DataFrame, stem: str, category: str) -> DataFrame:
    """image_id (number when the stem is one), category, top-left box to 3 places, score to 5."""
    rest = [c for c in det.columns if c not in (*G.CORNERS, "cls", "conf", "image_id")]
    return det.selectExpr(
        *rest, f"coalesce(cast(try_cast({stem} as bigint) as string), {stem}) as image_id", f"{category} as category_id",
        "array(round(x1, 3), round(y1, 3), round(x2 - x1, 3), round(y2 - y1, 3)) as bbox", "round(conf, 5) as score",
    )


def oriented_rows(det: DataFrame) -> DataFrame:
    """Rotated box and its corners, three places each."""
    corners = ", ".join(f"round({c}, 3)" for c in G.rotated_corners())
    return det.selectExpr(
        "*", "array(round(cx, 3), round(cy, 3), round(w, 3), round(h, 3), round(r, 3)) as rbox", f"array({corners}) as poly"
    )


def task_lines(oriented: DataFrame, names: str) -> DataFrame:
    """Per-class submission text: image, score, eight corners."""
    return oriented.selectExpr(
        f"replace({names}[cls], ' ', '-') as class", "image_id",
        "concat_ws(' ', image_id, round(conf, 5), array_join(transform(poly, c -> cast(c as string)), ' ')) as line",
    )


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """Sixteen hex digits over the JSON of the named columns."""
    return df.selectExpr("*", f"substring(sha2(to_json(struct({', '.join(columns)})), 256), 1, 16) as content_hash")


def sync_actions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare (file, split, content_hash) with what is on disk: skip, move, write or delete."""
    old = actual.selectExpr("file", "split as old_split", "content_hash as old_hash")
    return expected.join(old, "file", "full_outer").selectExpr(
        "file",
        """case when content_hash is null then 'delete' when old_hash is null then 'write' when old_hash <> content_hash then 'write'
            when old_split <> split then 'move' else 'skip' end as action""",
    )


def manifest_key(files: DataFrame) -> DataFrame:
    """One-row cache key over (path, length): order-free digests of 256 path buckets, hashed together.

    A single concatenated path list would pass through one task; bucket digests keep every step bounded.
    """
    buckets = files.groupBy(F.expr("pmod(xxhash64(path), 65536) as b")).agg(
        F.expr("sum(cast(length as decimal(38, 0))) as bytes"), F.expr("count(*) as n"), F.expr("bit_xor(xxhash64(path, length)) as x"),
        F.expr("sum(cast(xxhash64(length, path) as decimal(38, 0))) as s"),
    )
    folded = buckets.groupBy(F.expr("b div 256 as g")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(b, bytes, n, x, s))), v -> to_json(v)), '') as t"))
    return folded.selectExpr("g", "sha2(t, 256) as t").agg(
        F.expr("sha2(array_join(transform(array_sort(collect_list(struct(g, t))), v -> v.t), ''), 256) as key")
    )


def incremental_counts(files: DataFrame, cache: str | None, parse, path: str) -> DataFrame:
    """Scan results of all files (path, key), parsing only those whose key the cache does not hold; written to ``path``, the next cache.

    ``parse(files)`` gives (path, ...) rows. Files that are gone leave the cache. ``parsed`` says which rows were read anew.
    """
    spark = files.sparkSession
    if cache is None:
        fresh = parse(files).join(files.select("path", "key"), "path").selectExpr("*", "true as parsed")
    else:
        old = spark.read.parquet(cache).drop("parsed")
        held = old.join(files.select("path", "key"), ["path", "key"], "left_semi")
        changed = files.join(old.select("path", "key"), ["path", "key"], "left_anti")
        new = parse(changed).join(changed.select("path", "key"), "path")
        fresh = held.selectExpr("*", "false as parsed").unionByName(new.selectExpr("*", "true as parsed"))
    fresh.write.parquet(path)
    return spark.read.parquet(path)
