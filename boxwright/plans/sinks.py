"""Export queries: label lines of every task, written files read back, prediction files, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import masks as K
from boxwright.plans.bridge import table, v_det
from boxwright.plans.projections import V_ROT, v_rot
from boxwright.plans.registry import query
from boxwright.session import shared_folder
from boxwright.sinks import exports


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def g(*values: str) -> str:
    """Numbers as label text in DuckDB SQL."""
    return " || ' ' || ".join(f"printf('%g', {v})" for v in values)


@query("snk_01_polygon_export", f"""
SELECT image_id, det_id, cls || ' ' || {g("x1 / 640", "y1 / 480", "x2 / 640", "y1 / 480", "x2 / 640", "y2 / 480", "conf")} || ' ' || det_id % 1000 AS line FROM v_det""")
def polygon_export(spark: SparkSession, d: str) -> DataFrame:
    """Outlines with confidence and track id."""
    rows = v_det(spark, d).selectExpr("*", "array(struct(x1 as x, y1 as y), struct(x2 as x, y1 as y), struct(x2 as x, y2 as y)) as polygon", "det_id % 1000 as track_id")
    return rows.selectExpr("image_id", "det_id", f"{exports.polygon_line(width='640', height='480', conf=True, track=True)} as line")


_CORNERS = [f"(c{a} {s} w / 2 * {u} {t} h / 2 * {v}) / {n}" for s, t in (("+", "+"), ("+", "-"), ("-", "-"), ("-", "+")) for a, u, v, n in (("x", "cos(r)", "-sin(r)", "640"), ("y", "sin(r)", "cos(r)", "480"))]


@query("snk_01_oriented_export", f"WITH rot AS ({V_ROT}) SELECT image_id, det_id, cls || ' ' || {g(*_CORNERS, 'conf')} AS line FROM rot")
def oriented_export(spark: SparkSession, d: str) -> DataFrame:
    """Corners of rotated boxes with confidence."""
    return exports.oriented_lines(v_rot(spark, d), "640", "480", conf=True).select("image_id", "det_id", "line")


@query("snk_01_pose_export", f"""
SELECT image_id, det_id, cls || ' ' || {g("(x1 + x2) / 2 / 640", "(y1 + y2) / 2 / 480", "(x2 - x1) / 640", "(y2 - y1) / 480", "x1 / 640", "y1 / 480", "0.5E0", "(x1 + 20) / 640", "(y1 + 15) / 480", "0.25E0")} AS line FROM v_det""")
def pose_export(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with their keypoints and keypoint scores."""
    rows = v_det(spark, d).selectExpr("*", "array(struct(x1 as x, y1 as y, 0.5D as v), struct(x1 + 20 as x, y1 + 15 as y, 0.25D as v)) as kpts")
    return rows.selectExpr("image_id", "det_id", f"{exports.pose_line('640', '480')} as line")


@query("snk_01_class_export", """
WITH p AS (SELECT doc_id, k, ((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997.0E0 AS p FROM documents, (SELECT unnest(range(10)) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) AS rk FROM p)
SELECT doc_id, string_agg(printf('%.2f', p) || ' class_' || k, chr(10) ORDER BY rk) AS text FROM r WHERE rk <= 5 GROUP BY doc_id""")
def class_export(spark: SparkSession, d: str) -> DataFrame:
    """The five best classes of each file, a line each."""
    probs = "transform(sequence(0, 9), k -> ((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997D)"
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{probs} as probs", "transform(sequence(0, 9), k -> concat('class_', k)) as names")
    return rows.selectExpr("doc_id", f"{exports.class_line('probs', 'names')} as text")


@query("snk_01_written_labels", f"""
SELECT CAST(image_id % 4 AS INT) AS split, cls || ' ' || {g("(x1 + x2) / 2 / 640", "(y1 + y2) / 2 / 480", "(x2 - x1) / 640", "(y2 - y1) / 480")} || ' ' || det_id % 1000 AS line FROM v_det""")
def written_labels(spark: SparkSession, d: str) -> DataFrame:
    """Track lines written to a folder per split and read back."""
    lines = v_det(spark, d).selectExpr("*", "det_id % 1000 as track_id").selectExpr("image_id % 4 as split", f"{exports.box_line('640', '480', track=True)} as line")
    return exports.write_lines(lines, folder(spark)).selectExpr("cast(split as int) as split", "line")


@query("snk_03_written_tables", """
WITH t AS (SELECT image_id, det_id, conf, '{"cx":' || CAST((x1 + x2) / 2 AS VARCHAR) || ',"cy":' || CAST((y1 + y2) / 2 AS VARCHAR) || '}' AS centre FROM v_det)
SELECT 'csv' AS form, * FROM t UNION ALL SELECT 'json', * FROM t""")
def written_tables(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a nested column written as csv and as json, and read back."""
    nested = v_det(spark, d).selectExpr("image_id", "det_id", "conf", "struct((x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy) as centre")
    csv = exports.write_table(nested, folder(spark), "csv").selectExpr("'csv' as form", "image_id", "det_id", "conf", "centre")
    json = exports.write_table(nested, folder(spark), "json").selectExpr("'json' as form", "image_id", "det_id", "conf", "to_json(centre) as centre")
    return csv.unionByName(json)


@query("snk_04_pose_predictions", """
SELECT det_id, round(x1, 3) AS b0, 6 AS n, x1 AS k0, (y1 + 15) AS k4, (det_id % 3) / 2.0E0 AS k5 FROM v_det""")
def pose_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows with flat keypoints, written as json and read back."""
    rows = v_det(spark, d).selectExpr("*", "array(struct(x1 as x, y1 as y, 1D as v), struct(x1 + 20 as x, y1 + 15 as y, (det_id % 3) / 2D as v)) as kpts")
    made = exports.prediction_rows(rows.selectExpr("*", f"{exports.keypoint_values()} as keypoints").drop("kpts"), "cast(image_id as string)", "cls + 1")
    back = exports.write_table(made, folder(spark), "json")
    return back.selectExpr("det_id", "bbox[0] as b0", "size(keypoints) as n", "keypoints[0] as k0", "keypoints[4] as k4", "keypoints[5] as k5")


@query("snk_04_mask_predictions")
def mask_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows with run-length masks on an 80 x 60 grid."""
    det = v_det(spark, d)
    runs = K.box_masks(det.drop("conf", "cls"), "det_id", 80, 60, 8)
    coded = K.run_length_text(runs, ["image_id", "det_id"], 80 * 60).selectExpr("image_id", "det_id", "struct(array(60, 80) as size, rle as counts) as segmentation")
    made = exports.prediction_rows(det.join(coded, ["image_id", "det_id"]), "cast(image_id as string)", "cls + 1")
    return made.selectExpr("det_id", "image_id", "category_id", "score", "segmentation.size as size", "segmentation.counts as counts")


@query("snk_05_task_lines", f"""
WITH rot AS ({V_ROT}), c AS (SELECT *, {', '.join(f"round(c{a} {s} w / 2 * {u} {t} h / 2 * {v}, 3) AS q{i}" for i, (s, t, a, u, v) in enumerate([(s, t, *x) for s, t in (("+", "+"), ("+", "-"), ("-", "-"), ("-", "+")) for x in (("x", "cos(r)", "-sin(r)"), ("y", "sin(r)", "cos(r)"))]))} FROM rot)
SELECT 'plane-' || cls AS class, image_id, round(conf, 5) AS score, round({" + ".join(f"q{i}" for i in range(8))}, 3) AS corner_sum, 10 AS parts FROM c""")
def task_lines(spark: SparkSession, d: str) -> DataFrame:
    """Submission lines per class: image, score and eight corners, parsed back."""
    names = "transform(sequence(0, 9), k -> concat('plane ', k))"
    lines = exports.task_lines(exports.oriented_rows(v_rot(spark, d)), names)
    return lines.selectExpr("class", "image_id", "split(line, ' ') as p").selectExpr(
        "class", "image_id", "cast(p[1] as double) as score", "round(aggregate(slice(p, 3, 8), 0D, (s, x) -> s + cast(x as double)), 3) as corner_sum", "size(p) as parts"
    )


_LINES = "length(text) - length(replace(text, chr(10), '')) + 1"


@query("snk_07_incremental_scan", f"SELECT doc_id, {_LINES} AS n_lines, doc_id % 10 = 0 AS parsed FROM documents WHERE doc_id % 7 <> 3")
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan whose cache holds nine of ten files: the changed ones are parsed, the others answered, removed ones forgotten."""
    docs = table(spark, d, "documents").selectExpr("doc_id as path", "coalesce(text, '') as text")
    base = folder(spark)

    def parse(files: DataFrame) -> DataFrame:
        return docs.join(files.select("path"), "path").selectExpr("path", "length(text) - length(replace(text, '\\n', '')) + 1 as n_lines")

    before = docs.selectExpr("path", "if(path % 10 = 0, 'old', sha2(text, 256)) as key")
    exports.incremental_counts(before, None, parse, f"{base}/1")
    now = docs.where("path % 7 <> 3").selectExpr("path", "sha2(text, 256) as key")
    return exports.incremental_counts(now, f"{base}/1", parse, f"{base}/2").selectExpr("path as doc_id", "n_lines", "parsed")


@query("snk_10_run_folders", "SELECT 'run' || user_id % 20 AS run_id, count(*) AS epochs, round(max(value), 6) AS best FROM events WHERE user_id % 20 <> 7 GROUP BY 1")
def run_folders(spark: SparkSession, d: str) -> DataFrame:
    """Logs of many runs in their folders; the log of one run is unreadable and gives no rows."""
    base, events = folder(spark), table(spark, d, "events")
    logs = events.selectExpr("concat('run', user_id % 20) as run", "if(user_id % 20 = 7, concat('broken ', event_id), cast(event_id as string)) as epoch", "value as fitness")
    logs.write.partitionBy("run").option("header", True).csv(base)
    return exports.read_runs(spark, base, "epoch bigint, fitness double").groupBy("run_id").agg(F.expr("count(*) as epochs"), F.expr("round(max(fitness), 6) as best"))
