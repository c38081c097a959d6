"""Mixed source lists, frame streams and image header checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from boxwright.sources.labels_text import IMAGE_SUFFIXES

# Video suffixes.
VIDEO_SUFFIXES = ("asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv", "webm")


def media_list(paths: DataFrame) -> DataFrame:
    """Rank sources: images before videos, each sorted; unknown suffixes are ignored.

    The rank is a range-partitioned sort position, needed only when the list is consumed in order.
    """
    suffix = "lower(element_at(split(path, '[.]'), -1))"

    def listed(values: tuple[str, ...]) -> str:
        return f"{suffix} in ({', '.join(repr(v) for v in values)})"

    typed = paths.selectExpr("path", f"case when {listed(IMAGE_SUFFIXES)} then 'image' when {listed(VIDEO_SUFFIXES)} then 'video' end as media_type")
    return typed.where("media_type is not null").orderBy("media_type", "path")


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Text file with one source per line, or comma-separated lists."""
    return spark.read.text(path).selectExpr("explode(split(value, ',')) as path").selectExpr("trim(path) as path").where("path <> ''")


def every_kth(frames: DataFrame, k: int, column: str = "frame_no") -> DataFrame:
    """Frame stride."""
    return frames.where(f"pmod({column}, {k}) = 0")


def find_media(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """Media files (path, media_type) of a list of files, folders (their own files) and glob patterns. A source that does not exist is an error.

    Only names are listed, no contents are read.
    """
    files = spark.read.format("binaryFile").load(list(sources)).select("path")
    return media_list(files)


def newest_only(frames: DataFrame) -> DataFrame:
    """Unbuffered mode: one row per stream, its newest frame (map-side combined)."""
    from pyspark.sql import functions as F

    payload = ", ".join(c for c in frames.columns if c != "stream_id")
    return frames.groupBy("stream_id").agg(F.expr(f"max_by(struct({payload}), frame_no) as f")).select("stream_id", "f.*")


def _header(data: bytes) -> tuple[str | None, int | None, int | None, bool]:
    """Format, width, height and end-marker check from raw image bytes (orientation 6 and 8 swap the sides)."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), True
    if data[:2] != b"\xff\xd8":
        return None, None, None, False
    at, turn = 2, 1
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind, size = data[at + 1], int.from_bytes(data[at + 2:at + 4], "big")
        if kind == 0xE1 and data[at + 4:at + 10] == b"Exif\x00\x00":
            turn = _orientation(data[at + 10:at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = int.from_bytes(data[at + 5:at + 7], "big"), int.from_bytes(data[at + 7:at + 9], "big")
            w, h = (h, w) if turn in (6, 8) else (w, h)
            return "jpeg", w, h, data.rstrip(b"\x00")[-2:] == b"\xff\xd9"
        at += 2 + size
    return "jpeg", None, None, False


def _orientation(tiff: bytes) -> int:
    order = "little" if tiff[:2] == b"II" else "big"
    start = int.from_bytes(tiff[4:8], order)
    for i in range(int.from_bytes(tiff[start:start + 2], order)):
        entry = tiff[start + 2 + 12 * i:start + 14 + 12 * i]
        if int.from_bytes(entry[:2], order) == 0x0112:
            return int.from_bytes(entry[8:10], order)
    return 1


def check_images(files: DataFrame) -> DataFrame:
    """(path, content) rows to format, size and verdict; only bytes are read, nothing is decoded."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                kind, w, h, whole = _header(bytes(content))
                reason = "format" if kind is None or w is None else "small" if min(w, h) < 10 else None if whole else "truncated"
                out.append((path, kind, w, h, reason))
            yield pd.DataFrame(out, columns=["path", "format", "width", "height", "reason"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(scan, "path string, format string, width bigint, height bigint, reason string")
