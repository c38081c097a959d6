"""Model plug-ins as Arrow batches, lifecycle hooks and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "image_id bigint, slot int, cls int, conf double, x1 double, y1 double, x2 double, y2 double, ms double"
Batch = Callable[[pd.DataFrame], pd.DataFrame]


def score(images: DataFrame, model: Batch, schema: str = DETECTIONS) -> DataFrame:
    """Any batch callable (image rows to detection rows); the time per image goes into column ``ms``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            start = time.perf_counter()
            out = model(batch)
            yield out.assign(ms=(time.perf_counter() - start) * 1000 / max(len(batch), 1))

    return images.mapInPandas(run, schema)


def embed(rows: DataFrame, column: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Vector column from a batch callable."""

    @F.pandas_udf("array<float>")
    def vector(values: pd.Series) -> pd.Series:
        return model(values)

    return rows.select("*", vector(column).alias("embedding"))


def embedding_table(rows: DataFrame, column: str, encoder, path: str, dataset: str, model: str, force: bool = False) -> DataFrame:
    """Build the vectors of one (dataset, model) once, reuse them afterwards; ``force`` rebuilds that partition."""
    spark = rows.sparkSession
    part = f"{path}/dataset={dataset}/model={model}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(part)
    done = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS"))
    if force or not done:
        embed(rows, column, encoder).drop(column).write.mode("overwrite").parquet(part)
    return spark.read.parquet(part)


def outline(det: DataFrame, model: Batch) -> DataFrame:
    """Second-stage plug-in: detection rows to outlines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return det.mapInPandas(run, "image_id bigint, cls int, polygon array<double>")


def with_hooks(write: Callable[[DataFrame, int], None], hooks: dict[str, list[Callable]]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that calls the listed hooks of ``batch_start`` and ``batch_end``."""

    def run(batch: DataFrame, epoch: int) -> None:
        for hook in hooks.get("batch_start", []):
            hook(epoch)
        write(batch, epoch)
        for hook in hooks.get("batch_end", []):
            hook(epoch)

    return run


def register_table_functions(spark: SparkSession) -> None:
    """Table functions for SQL users, as SQL over their arguments: tile starts along a side, places of a mosaic's four patches."""
    last = "if(length <= size, 1, cast(ceil((length - size) / (size - gap) + 1) as int)) - 1"
    start = "if(i > 0 and i * (size - gap) + size > length, length - size, i * (size - gap))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tile_starts(length INT, size INT, gap INT) RETURNS TABLE (start BIGINT)
        RETURN SELECT cast({start} as bigint) FROM (SELECT explode(sequence(0, {last})) AS i, length, size, gap)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION mosaic_places(xc INT, yc INT, w INT, h INT, size INT) RETURNS TABLE (slot INT, x1 INT, y1 INT, x2 INT, y2 INT)
        RETURN SELECT slot, if(slot in (0, 2), greatest(xc - w, 0), xc), if(slot in (0, 1), greatest(yc - h, 0), yc),
          if(slot in (0, 2), xc, least(xc + w, 2 * size)), if(slot in (0, 1), yc, least(yc + h, 2 * size)) FROM (SELECT explode(sequence(0, 3)) AS slot)""")


def stub_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a detector: three boxes per image."""
    ids = np.repeat(batch["image_id"].to_numpy(), 3)
    slot = np.tile(np.arange(3), len(batch))
    x, y = (ids * 13 + slot * 101) % 500, (ids * 17 + slot * 67) % 380
    return pd.DataFrame({
        "image_id": ids, "slot": slot.astype("int32"), "cls": ((ids * 7 + slot * 3) % 10).astype("int32"),
        "conf": ((ids * 7919 + slot * 104729) % 1000) / 1000.0, "x1": x * 1.0, "y1": y * 1.0, "x2": x + 80.0, "y2": y + 60.0,
    })


def stub_embedder(values: pd.Series) -> pd.Series:
    """Deterministic stand-in for an encoder: the shares of four kinds of characters in the whole text."""
    text = values.fillna("")
    size = np.maximum(text.str.len().to_numpy(float), 1.0)
    shares = [text.str.count(f"[{kind}]").to_numpy(float) / size for kind in ("a-m", "n-z", "A-Z", "0-9")]
    return pd.Series(list(np.stack(shares, axis=1).astype(np.float32)))


def stub_outliner(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a segmenter: four points per detection."""
    return pd.DataFrame({
        "image_id": batch["image_id"], "cls": batch["cls"], "polygon": [[a, b, c, d] for a, b, c, d in zip(batch.x1, batch.y1, batch.x2, batch.y2)],
    })
