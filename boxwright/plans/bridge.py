"""Bridge views: give the driver's star schema a detection, truth, image and track meaning.

Ids are arithmetic functions of the row, so a bridge is a plain projection of its base table: no window,
no shuffle, no hot group. ``det_id`` ascends with descending confidence; its low digits mix the other row
columns and break ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.boxes import bound

WIDTH, HEIGHT, CLASSES = 640, 480, 10

VIEWS = {
    "v_det": """
SELECT image_id, (9972 - q) * 100000000000 + mix AS det_id, cls, q / 10000.0E0 AS conf,
       cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2
FROM (SELECT l_orderkey // 10 AS image_id, CAST(l_partkey % 10 AS INT) AS cls,
             (l_partkey * 7919 + l_suppkey * 10473 + l_linenumber * 31) % 9973 AS q,
             ((l_orderkey % 10) * 9999999967 + CAST(l_linenumber AS BIGINT) * 1234567891 + l_partkey * 1000003 + l_suppkey * 7368787
              + CAST(round(l_extendedprice * 100) AS BIGINT) * 13) % 99999999977 AS mix,
             CAST(40 + (l_partkey * 37 + l_orderkey * 11) % 560 AS DOUBLE) AS cx,
             CAST(40 + (l_suppkey * 53 + l_orderkey * 7) % 400 AS DOUBLE) AS cy,
             40 + 2 * l_quantity AS w, CAST(40 + (l_linenumber * 17) % 90 AS DOUBLE) AS h
      FROM lineitem) t""",
    "v_gt": """
SELECT image_id, det_id AS gt_id, CASE WHEN det_id % 7 = 0 THEN (cls + 1) % 10 ELSE cls END AS cls,
       x1 + (det_id % 5) * 3 AS x1, y1 + (det_id % 4) * 4 AS y1, x2 + (det_id % 5) * 3 AS x2, y2 + (det_id % 4) * 4 AS y2
FROM v_det WHERE det_id % 3 <> 1""",
    "v_image": """
SELECT o_orderkey // 10 AS image_id, 640 AS width, 480 AS height, min(o_orderpriority) AS split_hint, count(*) AS n_src
FROM orders GROUP BY o_orderkey // 10""",
    "v_track": """
SELECT user_id % 4 AS stream_id, user_id AS track_id, event_id AS frame_no, CAST(event_id % 5 AS INT) AS cls,
       CAST((event_id * 37 + user_id * 13) % 640 AS DOUBLE) AS cx, CAST((event_id * 91 + user_id * 29) % 480 AS DOUBLE) AS cy,
       CAST(20 + event_id % 37 AS DOUBLE) AS w, CAST(20 + event_id % 53 AS DOUBLE) AS h
FROM events""",
}

# One block of frames bounds every per-track window, however hot the track.
FRAME_BLOCK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(rows: DataFrame) -> DataFrame:
    """Rows whose formulas are worked out once, not again in every filter and expression of a query."""
    return bound(rows, **{c: c for c in rows.columns})


def v_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 10 as image_id",
        "cast(l_partkey % 10 as int) as cls",
        "(l_partkey * 7919 + l_suppkey * 10473 + l_linenumber * 31) % 9973 as q",
        "((l_orderkey % 10) * 9999999967 + l_linenumber * 1234567891L + l_partkey * 1000003 + l_suppkey * 7368787"
        " + cast(round(l_extendedprice * 100) as bigint) * 13) % 99999999977 as mix",
        "cast(40 + (l_partkey * 37 + l_orderkey * 11) % 560 as double) as cx",
        "cast(40 + (l_suppkey * 53 + l_orderkey * 7) % 400 as double) as cy",
        "40 + 2 * l_quantity as w",
        "cast(40 + (l_linenumber * 17) % 90 as double) as h",
    ).selectExpr(
        "image_id", "(9972 - q) * 100000000000 + mix as det_id", "cls", "q / 10000D as conf",
        "cx - w / 2 as x1", "cy - h / 2 as y1", "cx + w / 2 as x2", "cy + h / 2 as y2",
    ))


def v_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(v_det(spark, sf_dir).where("det_id % 3 <> 1").selectExpr(
        "image_id", "det_id as gt_id", "case when det_id % 7 = 0 then (cls + 1) % 10 else cls end as cls",
        "x1 + (det_id % 5) * 3 as x1", "y1 + (det_id % 4) * 4 as y1",
        "x2 + (det_id % 5) * 3 as x2", "y2 + (det_id % 4) * 4 as y2",
    ))


def v_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 10 as image_id")).agg(
        F.expr("min(o_orderpriority) as split_hint"), F.expr("count(*) as n_src")
    )
    return grouped.selectExpr("image_id", f"{WIDTH} as width", f"{HEIGHT} as height", "split_hint", "n_src")


def v_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 4 as stream_id", "user_id as track_id", "event_id as frame_no", "cast(event_id % 5 as int) as cls",
        "cast((event_id * 37 + user_id * 13) % 640 as double) as cx",
        "cast((event_id * 91 + user_id * 29) % 480 as double) as cy",
        "cast(20 + event_id % 37 as double) as w", "cast(20 + event_id % 53 as double) as h",
    )


def frame_block(column: str = "frame_no", size: int = FRAME_BLOCK) -> str:
    return f"{column} div {size}"
