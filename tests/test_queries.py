"""Registered queries against their oracles at the smallest scale (all of them with BOXWRIGHT_FULL=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "jon_02_overlap_join", "jon_06_greedy_match", "agg_05_average_precision", "agg_09_confusion_matrix", "win_01_greedy_nms", "win_02_fast_nms",
    "win_03_rotated_nms", "prj_02_letterbox", "src_02_label_text", "src_06_voc_xml", "snk_01_label_export", "agg_01_dataset_statistics", "top_03_stratified_split",
    "jon_04_mask_overlap", "jon_16_similarity_index", "win_09_line_counter", "agg_13_region_counts", "aug_04_cut_mix", "str_05_live_counter",
    "jon_08_assignment_total", "str_07_live_speed_reps", "str_08_live_alarm", "str_13_late_frames", "src_16_newest_per_trigger", "snk_01_written_labels", "snk_07_incremental_scan",
    "aug_01_perspective_outlines", "aug_08_polygon_stitching", "agg_23_drift_test", "win_12_chart_grid", "udf_03_lifecycle",
)
NAMES = sorted(entry.queries()) if os.environ.get("BOXWRIGHT_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data is absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert line.startswith(("ok", "rows-only")), line
