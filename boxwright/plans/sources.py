"""Source queries: rows of each format are derived from the bridge views, then parsed by the format's step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.plans.bridge import table, v_det, v_gt, v_image, v_track
from boxwright.plans.projections import rounded
from boxwright.plans.registry import query
from boxwright.sinks.exports import box_line
from boxwright.session import materialize
from boxwright.sources import formats, labels_text, media

XYWH = ("x", "y", "w", "h")
_N = "round((x1 + x2) / 2 / 640, 9) AS x, round((y1 + y2) / 2 / 480, 9) AS y, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h"


def r9(*columns: str) -> list[str]:
    return rounded(*columns, digits=9)


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label text of the truth boxes; images divisible by 5 carry one polygon line per object, others boxes."""
    numbers = {"x": "(x1 + x2) / 1280", "y": "(y1 + y2) / 960", "w": "(x2 - x1) / 640", "h": "(y2 - y1) / 480"}
    box = ", ".join(f"cast({e} as string)" for e in numbers.values())
    points = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    poly = ", ".join(f"cast({x} / 640 as string), cast({y} / 480 as string)" for x, y in points)
    return v_gt(spark, d).selectExpr(
        "concat('labels/', image_id, '.txt') as path",
        f"if(image_id % 5 = 0 and gt_id % 2 = 0, concat_ws(' ', cls, {poly}), concat_ws(' ', cls, {box})) as line",
    )


def chunked(rows: DataFrame, key: str, id_col: str, size: int = 64, salts: int = 64) -> DataFrame:
    """Add ``chunk``: at most ``size`` rows of a key share one; a hot key is numbered in salted parts."""
    salt = f"pmod(xxhash64({id_col}), {salts})"
    n = f"(row_number() over (partition by {key}, {salt} order by {id_col}) - 1) div {size}"
    return rows.selectExpr("*", f"struct({salt} as salt, {n} as n) as chunk")


@query("src_01_image_manifest", """
WITH p AS (SELECT './images/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '.tiff' END AS path FROM orders),
k AS (SELECT '/data' || substr(path, 2) AS path FROM p WHERE path NOT LIKE '%.txt')
SELECT path FROM k ORDER BY path LIMIT (SELECT CAST(round_even(count(*) * 0.5E0, 0) AS BIGINT) FROM k)""")
def image_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Suffix filter, relative lines resolved, first half of the sorted list."""
    raw = table(spark, d, "orders").selectExpr(
        "concat('./images/', o_orderkey, case o_orderkey % 4 when 0 then '.JPG' when 1 then '.png' when 2 then '.txt' else '.tiff' end) as value"
    ).selectExpr("if(value like './%', concat('/data', substring(value, 2)), value) as path")
    return labels_text.leading_share(raw.where(labels_text.image_suffix_test()), 0.5)


_BOXES = """
o AS (SELECT image_id, gt_id, cls, (image_id % 5 = 0 AND gt_id % 2 = 0) AS long, x1, y1, x2, y2 FROM v_gt),
f AS (SELECT image_id, bool_or(long) AS poly FROM o GROUP BY image_id)"""


@query("src_02_label_text", f"""
WITH {_BOXES}
SELECT 'labels/' || image_id || '.txt' AS path, cls, poly AS is_polygon,
       round(CASE WHEN poly AND NOT long THEN ((x1 + x2) / 1280 + (x2 - x1) / 640) / 2 ELSE (x1 + x2) / 1280 END, 9) AS x,
       round(CASE WHEN poly AND NOT long THEN abs((x1 + x2) / 1280 - (x2 - x1) / 640) ELSE (x2 - x1) / 640 END, 9) AS w
FROM o JOIN f USING (image_id)""")
def label_text(spark: SparkSession, d: str) -> DataFrame:
    """A long line makes polygons of every line in its file; a short line then is a two-point polygon."""
    return labels_text.parse_lines(label_lines(spark, d)).selectExpr("path", "cls", "is_polygon", *r9("x", "w"))


@query("src_03_folder_scan", """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, source AS name FROM documents),
n AS (SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS cls FROM (SELECT DISTINCT name FROM p))
SELECT split, name, CAST(cls AS INT) AS cls, count(*) AS n FROM p JOIN n USING (name) GROUP BY ALL""")
def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").selectExpr(
        "concat('/data/', if(doc_id % 10 = 0, 'val', 'train'), '/', source, '/', doc_id, '.jpg') as path"
    )
    return formats.folder_classes(files).groupBy("split", "name", "cls").agg(F.expr("count(*) as n"))


def coco_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """COCO-style JSON text, one document per image and annotation chunk, parsed back: duplicates, crowds and empty boxes included."""
    box = "array(x1, y1, if(det_id % 17 = 0, 0D, x2 - x1), y2 - y1)"
    ann = f"""struct(det_id as id, image_id, cls * 3 + 1 as category_id, {box} as bbox, if(det_id % 13 = 0, 1, 0) as iscrowd,
        if(det_id % 6 = 0, null, array(x1, y1, 2D)) as keypoints, array(array(x1, y1, x2, y1, x2, y2)) as segmentation)"""
    copies = f"if(det_id % 9 = 0, array({ann}, {ann}), array({ann}))"
    chunks = chunked(v_det(spark, d).join(v_image(spark, d), "image_id"), "image_id", "det_id")
    documents = chunks.groupBy("image_id", "width", "height", "chunk").agg(F.expr(f"flatten(collect_list({copies})) as annotations")).selectExpr(
        "concat(image_id, '-', chunk.salt, '-', chunk.n, '.json') as doc",
        "to_json(struct(array(struct(image_id as id, width, height, concat(image_id, '.jpg') as file_name)) as images, annotations)) as line",
    )
    parsed = documents.selectExpr("doc", f"from_json(line, '{formats.COCO_SCHEMA}') as r").selectExpr("doc", "r.*")
    # Images, annotations and classes are read from the same documents, so those are made and parsed once.
    return formats.coco_rows(materialize(parsed))


_COCO = f"""
a AS (SELECT image_id, cls * 3 + 1 AS category_id, det_id, {_N} FROM v_det JOIN v_image USING (image_id) WHERE det_id % 13 <> 0 AND det_id % 17 <> 0)"""


@query("src_04_coco_json", f"WITH {_COCO} SELECT image_id, category_id - 1 AS cls, x, y, w, h FROM a")
def coco_json(spark: SparkSession, d: str) -> DataFrame:
    images, anns = coco_tables(spark, d)
    return formats.coco_objects(images, anns).selectExpr("image_id", "cls", *r9(*XYWH))


@query("src_04_coco_polygons", """
SELECT image_id, det_id AS ann_id, CAST(cls * 3 AS INT) AS cls, round(x1 / width, 9) AS first_x, round(y2 / height, 9) AS last_y, CASE WHEN det_id % 9 = 0 THEN 2 ELSE 1 END AS copies
FROM v_det JOIN v_image USING (image_id) WHERE det_id % 13 <> 0 AND det_id % 17 <> 0""")
def coco_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Outline parts of the objects; repeated annotations are counted."""
    parts = formats.coco_polygons(*coco_tables(spark, d))
    return parts.groupBy("image_id", "ann_id", "cls", *[F.expr(f"round(coords[{i}], 9)").alias(n) for i, n in ((0, "first_x"), (5, "last_y"))]).agg(
        F.expr("cast(count(*) as int) as copies")
    )


@query("src_04_coco_pose", f"WITH {_COCO} SELECT image_id, count(*) AS n FROM a WHERE det_id % 6 <> 0 GROUP BY image_id")
def coco_pose(spark: SparkSession, d: str) -> DataFrame:
    """Rows without keypoints leave before duplicates are removed."""
    images, anns = coco_tables(spark, d)
    return formats.coco_objects(images, anns, keypoints=True).groupBy("image_id").agg(F.expr("count(*) as n"))


@query("src_05_ndjson", """
SELECT image_id || '.jpg' AS file, CASE WHEN image_id % 3 = 0 THEN 'segments' ELSE 'boxes' END AS kind, count(*) AS n, sum(cls) AS cls_sum,
       round(sum(CASE WHEN image_id % 3 = 0 THEN x1 / 640 ELSE (x1 + x2) / 1280 END), 8) AS first_sum FROM v_gt GROUP BY image_id""")
def ndjson(spark: SparkSession, d: str) -> DataFrame:
    """Image records as JSON text, parsed back; boxes win over later kinds, classification rows come last.

    Records hold at most 64 objects each, so a hot image is many records, not one.
    """
    box = "array(cast(cls as double), (x1 + x2) / 1280, (y1 + y2) / 960, (x2 - x1) / 640, (y2 - y1) / 480)"
    poly = "array(cast(cls as double), x1 / 640, y1 / 480, x2 / 640, y1 / 480, x2 / 640, y2 / 480)"
    records = chunked(v_gt(spark, d), "image_id", "gt_id").groupBy("image_id", "chunk").agg(
        F.expr(f"collect_list(if(image_id % 3 = 0, null, {box})) as boxes"), F.expr(f"collect_list({poly}) as segments")
    ).selectExpr("""to_json(struct('image' as type, concat(image_id, '.jpg') as file, 640 as width, 480 as height, 'train' as split,
        struct(boxes, segments, array(1) as classification) as annotations)) as line""")
    parsed = records.selectExpr(f"from_json(line, '{formats.NDJSON_SCHEMA}') as r").selectExpr("r.*")
    return formats.ndjson_objects(parsed).groupBy("file", "kind").agg(
        F.expr("count(*) as n"), F.expr("sum(cls) as cls_sum"), F.expr("round(sum(coords[0]), 8) as first_sum")
    )


@query("src_06_voc_xml", """
SELECT image_id || '.jpg' AS filename, cls - 1 AS cls, round(((x1 + x2) / 2 - 1) / 640, 9) AS x, round(((y1 + y2) / 2 - 1) / 480, 9) AS y, round((x2 - x1) / 640, 9) AS w
FROM v_gt WHERE cls BETWEEN 1 AND 8 AND gt_id % 10 <> 0""")
def voc_xml(spark: SparkSession, d: str) -> DataFrame:
    """Annotation XML text, parsed with the XML functions; unknown names and difficult objects are dropped."""
    xml = chunked(v_gt(spark, d), "image_id", "gt_id").groupBy("image_id", "chunk").agg(F.expr("""array_join(collect_list(concat('<object><name>c', cls,
        '</name><difficult>', if(gt_id % 10 = 0, 1, 0), '</difficult><bndbox><xmin>', x1, '</xmin><ymin>', y1, '</ymin><xmax>', x2, '</xmax><ymax>', y2,
        '</ymax></bndbox></object>')), '') as objects""")).selectExpr(
        "concat('<annotation><filename>', image_id, '.jpg</filename><size><width>640</width><height>480</height></size>', objects, '</annotation>') as line"
    )
    images = xml.selectExpr(f"from_xml(line, '{formats.VOC_SCHEMA}') as r").selectExpr("r.*")
    return formats.voc_objects(images, [f"c{i}" for i in range(1, 9)]).selectExpr("filename", "cls", *r9("x", "y", "w"))


@query("src_07_ignored_regions_csv", """
SELECT image_id, CAST(cls - 1 AS INT) AS cls, CAST(printf('%.6f', (CAST(round(x1) AS INT) + CAST(round(x2 - x1) AS INT) / 2) / 640) AS DOUBLE) AS x, CAST(printf('%.6f', CAST(round(x2 - x1) AS INT) / 640) AS DOUBLE) AS w FROM v_gt JOIN v_image USING (image_id) WHERE gt_id % 5 <> 0""")
def ignored_regions_csv(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated boxes whose fifth field marks ignored regions."""
    lines = v_gt(spark, d).selectExpr(
        "image_id", "concat_ws(',', cast(round(x1) as int), cast(round(y1) as int), cast(round(x2 - x1) as int), cast(round(y2 - y1) as int), if(gt_id % 5 = 0, 0, 1), cls, 0, 0) as line"
    )
    rows = lines.selectExpr("image_id", f"from_csv(line, '{formats.VISDRONE_SCHEMA}') as r").selectExpr("image_id", "r.*")
    sizes = v_image(spark, d).select("image_id", "width", "height")
    return formats.visdrone_objects(rows, sizes, "image_id").select("image_id", "cls", "x", "w")


@query("src_08_geojson", """
WITH t AS (SELECT unnest([11, 12, 13, 15, 17, 18, 19, 20, 21, 23]) AS type_id, unnest(range(10)) AS c)
SELECT image_id, CAST(c AS INT) AS cls, round((greatest(x1, 0) + least(x2, 640)) / 1280, 9) AS x, round((least(x2, 640) - greatest(x1, 0)) / 640, 9) AS w
FROM v_gt JOIN v_image USING (image_id) JOIN t ON t.type_id = 11 + cls WHERE gt_id % 8 <> 0""")
def geojson(spark: SparkSession, d: str) -> DataFrame:
    """Corner text with some broken rows; types outside the class list vanish."""
    features = v_gt(spark, d).selectExpr(
        "image_id", "11 + cls as type_id", "if(gt_id % 8 = 0, concat(x1, ',', y1, ',bad'), concat_ws(',', x1, y1, x2, y2)) as bounds_imcoords"
    )
    sizes = v_image(spark, d).select("image_id", "width", "height")
    # The class list has sixty rows.
    out = formats.xview_objects(features, sizes, F.broadcast(formats.xview_classes(spark)))
    return out.selectExpr("image_id", "cls", *r9("x", "w"))


@query("src_09_index_json", """
SELECT 'seq' || (image_id % 3) || '/' || image_id || '.jpg' AS path, cls, round((x1 + x2) / 2 / 1920, 9) AS x, round((y2 - y1) / 1200, 9) AS h FROM v_gt JOIN v_image USING (image_id)""")
def index_json(spark: SparkSession, d: str) -> DataFrame:
    """Annotations refer to images by index; folders come from a lookup array."""
    chunks = chunked(v_gt(spark, d), "image_id", "gt_id").join(v_image(spark, d).select("image_id"), "image_id")
    ann = "struct(1L as image_id, cls as category_id, array(x1, y1, x2 - x1, y2 - y1) as bbox)"
    documents = chunks.groupBy("image_id", "chunk").agg(F.expr(f"collect_list({ann}) as annotations")).selectExpr(
        "concat(image_id, '-', chunk.salt, '-', chunk.n, '.json') as doc",
        """to_json(struct(array(struct('unused.jpg' as name, 0 as sid), struct(concat(image_id, '.jpg') as name, int(image_id % 3) as sid)) as images,
        annotations, array('seq0', 'seq1', 'seq2') as seq_dirs)) as line""",
    )
    parsed = documents.selectExpr("doc", f"from_json(line, '{formats.ARGOVERSE_SCHEMA}') as r").selectExpr("doc", "r.*")
    return formats.argoverse_objects(*formats.argoverse_rows(parsed)).selectExpr("path", "cls", *r9("x", "h"))


@query("src_10_corner_csv", """
SELECT image_id || '.jpg' AS image, 0 AS cls, CAST(printf('%.5f', (x1 + x2) / 2 / 1000) AS DOUBLE) AS x, CAST(printf('%.5f', (y1 + y2) / 2 / 1000) AS DOUBLE) AS y FROM v_gt""")
def corner_csv(spark: SparkSession, d: str) -> DataFrame:
    lines = v_gt(spark, d).selectExpr("concat_ws(',', concat(image_id, '.jpg'), x1, y1, x2, y2, 'object', 1000, 1000) as line")
    rows = lines.selectExpr(f"from_csv(line, '{formats.SKU_SCHEMA}') as r").selectExpr("r.*")
    return formats.sku_objects(rows).select("image", "cls", "x", "y")


@query("src_11_category_order", f"WITH {_COCO} SELECT image_id, CAST((category_id - 1) // 3 AS INT) AS cls, round(greatest(0.0, x - w / 2), 9) AS left_edge FROM a")
def category_order(spark: SparkSession, d: str) -> DataFrame:
    """Class = position of the category among those present; boxes clipped to the image."""
    images, anns = coco_tables(spark, d)
    # The class list is as small as the set of categories.
    out = formats.coco_objects(images, anns, formats.sorted_classes(anns))
    return out.selectExpr("image_id", "cls", "round(greatest(0D, round(x, 9) - round(w, 9) / 2), 9) as left_edge")


@query("src_12_corner_text", """
SELECT 'scene/' || image_id || '.txt' AS path, cls, round(x1 / 640, 9) AS a, round(y2 / 480, 9) AS b FROM v_gt JOIN v_image USING (image_id) WHERE gt_id % 20 <> 0""")
def corner_text(spark: SparkSession, d: str) -> DataFrame:
    """Eight corners, class name, difficulty; short lines are skipped."""
    names = ", ".join(f"'{n}'" for n in formats.DOTA_NAMES)
    lines = v_gt(spark, d).selectExpr(
        "concat('scene/', image_id, '.txt') as path",
        f"if(gt_id % 20 = 0, 'imagesource:x', concat_ws(' ', x1, y1, x2, y1, x2, y2, x1, y2, array({names})[cls], 0)) as line",
    )
    sizes = v_image(spark, d).selectExpr("concat('scene/', image_id, '.txt') as path", "width", "height")
    return formats.dota_objects(lines, sizes).selectExpr("path", "cls", "round(corners[0], 9) as a", "round(corners[5], 9) as b")


@query("src_13_caption_spans", """
WITH a AS (SELECT doc_id AS image_id, k AS ann_id, lower(trim(substr(text, CAST(1 + (k * 7919 + doc_id * 31) % greatest(length(text), 1) AS BIGINT), 4) || ' ' || substr(text, CAST(1 + (k * 104729 + doc_id * 17) % greatest(length(text), 1) AS BIGINT), 3))) AS name FROM documents, (SELECT unnest(range(6)) AS k)),
f AS (SELECT image_id, name, min(ann_id) AS f FROM a WHERE name <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f) - 1 AS cls FROM f)
SELECT a.image_id, a.ann_id, name, CAST(cls AS INT) AS cls FROM a JOIN r USING (image_id, name)""")
def caption_spans(spark: SparkSession, d: str) -> DataFrame:
    """Two spans anywhere in the caption per annotation; the number of a category is its first-appearance rank."""
    docs = table(spark, d, "documents")
    one, two = (f"((ann_id * {a} + image_id * {b}) % greatest(size, 1))" for a, b in ((7919, 31), (104729, 17)))
    anns = docs.selectExpr("doc_id as image_id", "length(text) as size", "explode(sequence(0L, 5L)) as ann_id").selectExpr(
        "image_id", "ann_id", f"array(array(int({one}), int({one} + 4)), array(int({two}), int({two} + 3))) as spans"
    )
    out = formats.caption_spans(docs.selectExpr("doc_id as image_id", "text as caption"), anns)
    return out.select("image_id", "ann_id", "name", "cls")


@query("src_14_class_dimension", "SELECT cls, 'class_' || cls AS name, count(*) AS n FROM v_gt GROUP BY cls")
def class_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Default names of a dataset description, joined to the truth counts."""
    names = formats.class_dimension(spark, {"nc": 10})
    return v_gt(spark, d).groupBy("cls").agg(F.expr("count(*) as n")).join(names, "cls").select("cls", "name", "n")


@query("src_15_media_list", """
SELECT path, media_type FROM (SELECT 'src/' || event_id || CASE event_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' ELSE '.doc' END AS path,
CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS media_type FROM events) WHERE media_type IS NOT NULL""")
def media_list(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "events").selectExpr(
        "concat('src/', event_id, case event_id % 3 when 0 then '.jpg' when 1 then '.MP4' else '.doc' end) as path"
    )
    return media.media_list(paths)


@query("src_16_newest_frame", "SELECT stream_id, max(frame_no) AS frame_no, arg_max(track_id, frame_no) AS track_id FROM v_track GROUP BY stream_id")
def newest_frame(spark: SparkSession, d: str) -> DataFrame:
    return media.newest_only(v_track(spark, d)).select("stream_id", "frame_no", "track_id")


@query("src_17_frame_stride", "SELECT stream_id, frame_no, track_id FROM v_track WHERE frame_no % 5 = 0")
def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    return media.every_kth(v_track(spark, d), 5).select("stream_id", "frame_no", "track_id")


@query("src_19_coco_direct", f"WITH {_COCO} SELECT CAST((category_id - 1) // 3 AS INT) AS cls, count(*) AS n, count(DISTINCT image_id) AS images FROM a GROUP BY category_id")
def coco_direct(spark: SparkSession, d: str) -> DataFrame:
    images, anns = coco_tables(spark, d)
    out = formats.coco_objects(images, anns, formats.sorted_classes(anns))
    return out.groupBy("cls").agg(F.expr("count(*) as n"), F.expr("count(distinct image_id) as images"))


@query("jon_01_image_label_pairing", """
SELECT i.image_id, CASE WHEN i.image_id % 7 = 0 THEN 'missing' WHEN g.n IS NULL THEN 'empty' ELSE 'found' END AS status
FROM v_image i LEFT JOIN (SELECT image_id, count(*) AS n FROM v_gt GROUP BY 1) g USING (image_id)""")
def image_label_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Images paired with label files by the path rule; a missing file is not an empty file."""
    images = v_image(spark, d).selectExpr("image_id", "concat('/data/images/train/', image_id, '.jpg') as img")
    files = v_image(spark, d).where("image_id % 7 <> 0").selectExpr("concat('/data/labels/train/', image_id, '.txt') as path")
    objects = v_gt(spark, d).groupBy("image_id").agg(F.expr("count(*) as n")).selectExpr("concat('/data/labels/train/', image_id, '.txt') as path", "n")
    paired = images.selectExpr("image_id", f"{labels_text.label_path('img')} as path")
    return paired.join(files.selectExpr("path", "true as present"), "path", "left").join(objects, "path", "left").selectExpr(
        "image_id", "case when present is null then 'missing' when n is null then 'empty' else 'found' end as status"
    )


@query("jon_12_class_remap", """
WITH m AS (SELECT id, CASE WHEN id IN (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91) THEN NULL ELSE id - 1 - (SELECT count(*) FROM (SELECT unnest([12, 26, 29, 30, 45, 66, 68, 69, 71, 83]) AS g) WHERE g < id) END AS cls FROM (SELECT unnest(range(1, 92)) AS id))
SELECT det_id % 91 + 1 AS category_id, CAST(m.cls AS INT) AS cls, count(*) AS n FROM v_det JOIN m ON m.id = det_id % 91 + 1 GROUP BY ALL""")
def class_remap(spark: SparkSession, d: str) -> DataFrame:
    """Published 91 categories to 80 classes; gaps map to null."""
    rows = v_det(spark, d).selectExpr("cast(det_id % 91 + 1 as int) as category_id")
    # 91 rows, so the broadcast is bounded.
    mapped = rows.join(F.broadcast(formats.category_map(spark)), "category_id")
    return mapped.groupBy("category_id", "cls").agg(F.expr("count(*) as n")).selectExpr("cast(category_id as bigint) as category_id", "cls", "n")


def dirty_lines(spark: SparkSession, d: str) -> DataFrame:
    """Box label lines with planted faults."""
    x = "case when gt_id % 997 = 1 then 1.2D when gt_id % 991 = 1 then -0.02D else least(1D, (x1 + x2) / 1280) end"
    base = v_gt(spark, d).selectExpr(
        "concat('labels/', image_id, '.txt') as path", "gt_id",
        f"concat_ws(' ', if(gt_id % 983 = 1, 12, cls), {x}, least(1D, (y1 + y2) / 960), (x2 - x1) / 640, (y2 - y1) / 480) as line",
    )
    return base.select("path", "line").unionByName(base.where("gt_id % 50 = 0").select("path", "line"))


_DIRTY = """
d0 AS (SELECT image_id, gt_id, CASE WHEN gt_id % 983 = 1 THEN 12 ELSE cls END AS cls,
   CASE WHEN gt_id % 997 = 1 THEN 1.2E0 WHEN gt_id % 991 = 1 THEN -0.02E0 ELSE least(1.0E0, (x1 + x2) / 1280) END AS x, least(1.0E0, (y1 + y2) / 960) AS y, (x2 - x1) / 640 AS w, (y2 - y1) / 480 AS h FROM v_gt),
dd AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE gt_id % 50 = 0),
v AS (SELECT image_id, count(*) AS n_objects, count(*) - count(DISTINCT (cls, x, y, w, h)) AS n_duplicates,
   CASE WHEN bool_or(greatest(x, y, w, h) > 1.01E0) THEN 'out of bounds' WHEN bool_or(least(x, y, w, h) < -0.01E0) THEN 'negative' WHEN bool_or(cls >= 10) THEN 'class' END AS reason FROM dd GROUP BY image_id)"""


@query("prj_07_label_rules", f"WITH {_DIRTY} SELECT 'labels/' || image_id || '.txt' AS path, n_objects, n_duplicates, reason FROM v")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    """First broken rule and duplicate count per label file."""
    return labels_text.verdicts(labels_text.parse_lines(dirty_lines(spark, d)), 10).selectExpr("path", "n_objects", "n_duplicates", "reason")


@query("agg_02_scan_report", f"""WITH {_DIRTY}
SELECT count(*) FILTER (image_id % 7 = 0) AS missing, count(*) FILTER (image_id % 7 <> 0 AND n_objects IS NULL) AS empty,
       count(*) FILTER (image_id % 7 <> 0 AND n_objects IS NOT NULL AND reason IS NULL) AS found, count(*) FILTER (image_id % 7 <> 0 AND reason IS NOT NULL) AS corrupt,
       CAST(sum(n_duplicates) FILTER (image_id % 7 <> 0 AND reason IS NULL) AS BIGINT) AS duplicates FROM v_image LEFT JOIN v USING (image_id)""")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters over the images of the dataset."""
    verdict = labels_text.verdicts(labels_text.parse_lines(dirty_lines(spark, d)), 10)
    path = "concat('labels/', image_id, '.txt') as path"
    images, files = v_image(spark, d).selectExpr(path), v_image(spark, d).where("image_id % 7 <> 0").selectExpr(path)
    report = labels_text.scan_report(images, files, verdict)
    counts = [F.expr(f"count_if(status = '{s}') as {s}") for s in ("missing", "empty", "found", "corrupt")]
    return report.agg(*counts, F.expr("sum(if(status = 'found', n_duplicates, 0)) as duplicates"))


@query("snk_01_label_export", """
WITH l AS (SELECT image_id, det_id, cls || ' ' || printf('%g', (x1 + x2) / 1280) || ' ' || printf('%g', (y1 + y2) / 960) || ' ' || printf('%g', (x2 - x1) / 640) || ' ' || printf('%g', (y2 - y1) / 480) || ' ' || printf('%g', conf) AS line FROM v_det)
SELECT image_id, det_id, line FROM l""")
def label_export(spark: SparkSession, d: str) -> DataFrame:
    """Text lines of the export; the writer keeps one line per row and partitions by image bucket."""
    return v_det(spark, d).selectExpr("image_id", "det_id", f"{box_line('640', '480', conf=True)} as line")



@query("prj_08_image_headers", """
SELECT CAST(doc_id AS VARCHAR) AS path, 'png' AS format, CAST(n_chars % 5000 AS BIGINT) AS width, CAST(doc_id % 4000 AS BIGINT) AS height,
       CASE WHEN least(n_chars % 5000, doc_id % 4000) < 10 THEN 'small' END AS reason FROM documents""")
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header bytes written from table sizes, read back by the byte scanner."""
    head = "concat('89504E470D0A1A0A0000000D49484452', lpad(hex(n_chars % 5000), 8, '0'), lpad(hex(doc_id % 4000), 8, '0'))"
    files = table(spark, d, "documents").selectExpr("cast(doc_id as string) as path", f"unhex({head}) as content")
    return media.check_images(files)
