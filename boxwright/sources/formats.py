"""Readers for published annotation formats.

Each format has a reader over files and a DataFrame step that does the work, so the step also runs over rows
that are already in a table. Results are normalised centre boxes unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.text import fixed_round

COCO_SCHEMA = (
    "images array<struct<id: bigint, width: int, height: int, file_name: string>>,"
    "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, iscrowd: int,"
    " segmentation: string, keypoints: array<double>>>,"
    "categories array<struct<id: int, name: string>>"
)
NDJSON_SCHEMA = (
    "type string, task string, class_names map<string,string>, kpt_shape array<int>, file string, url string, width int, height int, split string,"
    "annotations struct<boxes: array<array<double>>, segments: array<array<double>>, pose: array<array<double>>,"
    " obb: array<array<double>>, classification: array<int>>"
)
VOC_SCHEMA = (
    "filename string, size struct<width: int, height: int>,"
    "object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
)
SKU_SCHEMA = "image string, x1 double, y1 double, x2 double, y2 double, class string, image_width double, image_height double"
VISDRONE_SCHEMA = "x int, y int, w int, h int, score int, category int, truncation int, occlusion int"
XVIEW_SCHEMA = "features array<struct<properties: struct<bounds_imcoords: string, image_id: string, type_id: int>>>"
ARGOVERSE_SCHEMA = (
    "images array<struct<name: string, sid: int>>, annotations array<struct<image_id: bigint, category_id: int, bbox: array<double>>>,"
    "seq_dirs array<string>"
)

# Published category numbers 1..90 with these gaps are renumbered without them.
COCO_GAPS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)
# Aerial type numbers in class order; the position is the class.
XVIEW_TYPES = (
    11, 12, 13, 15, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 32, 33, 34, 35, 36, 37, 38, 40, 41, 42, 44, 45, 47, 49,
    50, 51, 52, 53, 54, 55, 56, 57, 59, 60, 61, 62, 63, 64, 65, 66, 71, 72, 73, 74, 76, 77, 79, 83, 84, 86, 89, 91, 93, 94,
)
# Aerial scene class names in class order.
DOTA_NAMES = (
    "plane", "ship", "storage-tank", "baseball-diamond", "tennis-court", "basketball-court", "ground-track-field", "harbor",
    "bridge", "large-vehicle", "small-vehicle", "helicopter", "roundabout", "soccer-ball-field", "swimming-pool",
    "container-crane", "airport", "helipad",
)


def category_map(spark: SparkSession) -> DataFrame:
    """Dimension from 1-based published categories (91 with gaps) to 80 classes; gaps map to null."""
    gaps = ", ".join(map(str, COCO_GAPS))
    return spark.range(1, 92).selectExpr(
        "cast(id as int) as category_id",
        f"if(id in ({gaps}) or id = 91, null, cast(id - 1 - size(filter(array({gaps}), g -> g < id)) as int)) as cls",
    )


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows of COCO-style JSON files, each with the file it came from (``doc``)."""
    return coco_rows(spark.read.schema(COCO_SCHEMA).option("multiLine", True).json(path).selectExpr("*", "_metadata.file_path as doc"))


def coco_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows of parsed documents; image ids are unique inside a document (``doc``) only."""
    return documents.selectExpr("doc", "inline(images)"), documents.selectExpr("doc", "inline(annotations)")


def coco_polygons(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Normalised outline parts of the objects, one row per part; run-length masks and parts under three points have none."""
    size = images.selectExpr("doc", "id as image_id", "file_name", "width", "height")
    parts = annotations.where("not coalesce(cast(iscrowd as boolean), false) and bbox[2] > 0 and bbox[3] > 0 and segmentation like '[%'").selectExpr(
        "doc", "image_id", "id as ann_id", "category_id - 1 as cls", "posexplode(from_json(segmentation, 'array<array<double>>')) as (part, v)"
    ).where("size(v) >= 6")
    coords = "transform(v, (c, i) -> c / if(i % 2 = 0, width, height)) as coords"
    return parts.join(size, ["doc", "image_id"]).selectExpr("doc", "image_id", "file_name", "ann_id", "cls", "part", coords)


def coco_objects(images: DataFrame, annotations: DataFrame, classes: DataFrame | None = None, keypoints: bool = False) -> DataFrame:
    """Normalised centre boxes; crowds, empty boxes and exact duplicates are dropped.

    ``classes`` maps category_id to cls; without it the class is category_id - 1.
    """
    size = images.selectExpr("doc", "id as image_id", "file_name", "width", "height")
    rows = annotations.where("not coalesce(cast(iscrowd as boolean), false) and bbox[2] > 0 and bbox[3] > 0")
    if keypoints:
        rows = rows.where("keypoints is not null")
    if classes is not None:
        rows = rows.join(classes, "category_id").where("cls is not null")
    else:
        rows = rows.selectExpr("*", "category_id - 1 as cls")
    boxed = rows.join(size, ["doc", "image_id"]).selectExpr(
        "doc", "image_id", "file_name", "cls", "(bbox[0] + bbox[2] / 2) / width as x", "(bbox[1] + bbox[3] / 2) / height as y",
        "bbox[2] / width as w", "bbox[3] / height as h", *(["keypoints"] if keypoints else []),
    )
    return boxed.dropDuplicates(["doc", "image_id", "cls", "x", "y", "w", "h"])


def sorted_classes(annotations: DataFrame, column: str = "category_id") -> DataFrame:
    """Category numbers in order become 0..n-1; the window runs over the distinct categories only."""
    return annotations.select(column).distinct().selectExpr(column, f"cast(row_number() over (order by {column}) - 1 as int) as cls")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NDJSON_SCHEMA).json(path)


def ndjson_objects(records: DataFrame) -> DataFrame:
    """Objects of the image records; an image uses the first annotation kind it has, in a fixed order."""
    images = records.where("type = 'image'")
    kind = " ".join(f"when size(annotations.{k}) > 0 then '{k}'" for k in ("boxes", "segments", "pose", "obb"))
    values = " ".join(f"when size(annotations.{k}) > 0 then annotations.{k}" for k in ("boxes", "segments", "pose", "obb"))
    picked = images.selectExpr(
        "file", "split", "width", "height",
        f"case {kind} when size(annotations.classification) > 0 then 'classification' end as kind",
        f"case {values} when size(annotations.classification) > 0 then transform(annotations.classification, c -> array(cast(c as double))) end as rows",
    )
    return picked.selectExpr("file", "split", "kind", "posexplode(rows) as (pos, v)").selectExpr(
        "file", "split", "kind", "pos", "cast(v[0] as int) as cls", "slice(v, 2, size(v)) as coords"
    )


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").schema(VOC_SCHEMA).option("rowTag", "annotation").load(path)


def voc_objects(images: DataFrame, names: list[str]) -> DataFrame:
    """Objects with a known name that are not marked difficult; the box centre moves by one pixel."""
    listed = ", ".join(f"'{n}'" for n in names)
    return images.selectExpr("filename", "size.width as iw", "size.height as ih", "inline(object)").where(
        f"name in ({listed}) and coalesce(difficult, 0) <> 1"
    ).selectExpr(
        "filename", f"cast(array_position(array({listed}), name) - 1 as int) as cls",
        "((bndbox.xmin + bndbox.xmax) / 2 - 1) / iw as x", "((bndbox.ymin + bndbox.ymax) / 2 - 1) / ih as y",
        "(bndbox.xmax - bndbox.xmin) / iw as w", "(bndbox.ymax - bndbox.ymin) / ih as h",
    )


def read_visdrone(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VISDRONE_SCHEMA).csv(path).selectExpr("*", "_metadata.file_path as path")


def visdrone_objects(rows: DataFrame, sizes: DataFrame, key: str = "path") -> DataFrame:
    """Rows with a zero score field are ignored regions; classes start at 0."""
    return rows.where("score <> 0").join(sizes, key).selectExpr(
        key, "category - 1 as cls", f"{fixed_round('((x + w / 2) / width)', 6)} as x", f"{fixed_round('((y + h / 2) / height)', 6)} as y",
        f"{fixed_round('(w / width)', 6)} as w", f"{fixed_round('(h / height)', 6)} as h",
    )


def xview_classes(spark: SparkSession) -> DataFrame:
    listed = ", ".join(map(str, XVIEW_TYPES))
    return spark.range(1).selectExpr(f"posexplode(array({listed})) as (cls, type_id)")


def read_xview(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(XVIEW_SCHEMA).option("multiLine", True).json(path).selectExpr("inline(features)").selectExpr("properties.*")


def xview_objects(features: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Corner text to clipped normalised boxes; rows that do not parse or have no class are skipped one by one."""
    parsed = features.selectExpr("image_id", "type_id", "transform(split(bounds_imcoords, ','), t -> try_cast(t as double)) as b")
    good = parsed.where("size(b) = 4 and forall(b, v -> v is not null)").join(classes, "type_id").join(sizes, "image_id")
    clipped = good.selectExpr(
        "image_id", "cls", "width", "height", "least(greatest(b[0], 0D), width) as x1", "least(greatest(b[1], 0D), height) as y1",
        "least(greatest(b[2], 0D), width) as x2", "least(greatest(b[3], 0D), height) as y2",
    )
    return clipped.selectExpr(
        "image_id", "cls", "(x1 + x2) / 2 / width as x", "(y1 + y2) / 2 / height as y", "(x2 - x1) / width as w", "(y2 - y1) / height as h"
    )


def read_argoverse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Image rows by array index with their sequence folder, and annotation rows, each with its file (``doc``)."""
    return argoverse_rows(spark.read.schema(ARGOVERSE_SCHEMA).option("multiLine", True).json(path).selectExpr("*", "_metadata.file_path as doc"))


def argoverse_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows of parsed documents; an index means its own document (``doc``)."""
    images = documents.selectExpr("doc", "seq_dirs", "posexplode(images) as (pos, i)").selectExpr(
        "doc", "cast(pos as bigint) as image_id", "i.name as name", "seq_dirs[i.sid] as folder"
    )
    return images, documents.selectExpr("doc", "inline(annotations)")


def argoverse_objects(images: DataFrame, annotations: DataFrame, width: int = 1920, height: int = 1200) -> DataFrame:
    """Annotations refer to images by index; the frame size is fixed."""
    return annotations.join(images, ["doc", "image_id"]).selectExpr(
        "doc", "concat(folder, '/', name) as path", "category_id as cls", f"(bbox[0] + bbox[2] / 2) / {width} as x",
        f"(bbox[1] + bbox[3] / 2) / {height} as y", f"bbox[2] / {width} as w", f"bbox[3] / {height} as h",
    )


def read_sku(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKU_SCHEMA).csv(path)


def sku_objects(rows: DataFrame) -> DataFrame:
    """Single class, five decimals."""
    return rows.selectExpr(
        "image", "0 as cls", f"{fixed_round('((x1 + x2) / 2 / image_width)', 5)} as x", f"{fixed_round('((y1 + y2) / 2 / image_height)', 5)} as y",
        f"{fixed_round('((x2 - x1) / image_width)', 5)} as w", f"{fixed_round('((y2 - y1) / image_height)', 5)} as h",
    )


def dota_objects(lines: DataFrame, sizes: DataFrame, names: tuple[str, ...] = DOTA_NAMES) -> DataFrame:
    """Eight corner coordinates, class name, difficulty; short rows are skipped, unknown names fail the job."""
    listed = ", ".join(f"'{n}'" for n in names)
    parts = lines.selectExpr("path", r"split(trim(line), '\\s+') as t").where("size(t) >= 9").join(sizes, "path")
    cls = f"cast(array_position(array({listed}), t[8]) - 1 as int)"
    coords = "transform(sequence(0, 7), i -> cast(t[i] as double) / if(i % 2 = 0, width, height))"
    return parts.selectExpr(
        "path", f"if({cls} < 0, cast(raise_error(concat('unknown class ', t[8])) as int), {cls}) as cls", f"{coords} as corners"
    )


def caption_spans(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Category text of each annotation from caption spans, and its number by first appearance in the image."""
    text = "lower(trim(array_join(transform(spans, s -> substring(caption, s[0] + 1, s[1] - s[0])), ' ')))"
    named = annotations.join(images, "image_id").selectExpr("image_id", "ann_id", f"{text} as name").where("name <> ''")
    first = named.groupBy("image_id", "name").agg(F.expr("min(ann_id) as first_ann"))
    ranked = first.selectExpr("image_id", "name", "cast(row_number() over (partition by image_id order by first_ann) - 1 as int) as cls")
    return named.join(ranked, ["image_id", "name"])


def folder_classes(files: DataFrame) -> DataFrame:
    """Split and class from a path split/class/file; class numbers follow sorted names inside the dataset."""
    parts = files.selectExpr("path", "element_at(split(path, '/'), -3) as split", "element_at(split(path, '/'), -2) as name")
    names = parts.select("name").distinct().selectExpr("name", "cast(row_number() over (order by name) - 1 as int) as cls")
    return parts.join(names, "name")


def resolve_split(available: list[str], wanted: str) -> str | None:
    """val falls back to validation then valid; val and test stand in for each other."""
    aliases = {"val": ("val", "validation", "valid", "test"), "test": ("test", "val", "validation", "valid")}
    return next((s for s in aliases.get(wanted, (wanted,)) if s in available), None)


def class_dimension(spark: SparkSession, config: dict) -> DataFrame:
    """Class rows from a dataset description; names or a count is required and both must agree."""
    names, nc = config.get("names"), config.get("nc")
    if names is None and nc is None:
        raise ValueError("names or nc is required")
    if names is not None and nc is not None and len(names) != nc:
        raise ValueError(f"{len(names)} names for nc={nc}")
    pairs = [(i, f"class_{i}") for i in range(nc)] if names is None else sorted(
        (int(k), str(v)) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))
    )
    if [i for i, _ in pairs] != list(range(len(pairs))):
        raise ValueError("class ids must run from 0 without gaps")
    return spark.createDataFrame(pairs, "cls int, name string")


def split_dimension(spark: SparkSession, config: dict) -> DataFrame:
    """Split rows with paths resolved against the dataset root."""
    config = {**config, "val": config.get("val", config.get("validation"))}
    for need in ("train", "val"):
        if not config.get(need):
            raise ValueError(f"'{need}' is missing")
    root = str(config.get("path", ".")).rstrip("/")
    rows = []
    for split in ("train", "val", "test"):
        paths = config.get(split) or []
        for p in [paths] if isinstance(paths, str) else paths:
            rows.append((split, p if p.startswith("/") else f"{root}/{p.removeprefix('./')}"))
    return spark.createDataFrame(rows, "split string, path string")
