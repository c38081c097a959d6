"""Hand-made rows for the rules that are easy to get wrong."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions.text import fixed_round, general
from boxwright.operators import augment, boxes, datasets, evaluation, keypoints, masks, matching, nms, overlap, scans, search, tiles, tracks
from boxwright.operators.assignment import best_pairs, solve, solve_pairs
from boxwright.operators.augment import stitch
from boxwright.sinks import exports
from boxwright.sources import formats, labels_text, media

DET = "image_id bigint, det_id bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
GT = "image_id bigint, gt_id bigint, cls int, x1 double, y1 double, x2 double, y2 double"
OBS = "stream_id bigint, track_id bigint, frame_no bigint, cls int, cx double, cy double"


def det(spark, *rows):
    return spark.createDataFrame([(1, i, 0, conf, *map(float, box)) for i, (conf, box) in enumerate(rows)], DET)


def gt(spark, *rows):
    return spark.createDataFrame([(1, i, 0, *map(float, box)) for i, box in enumerate(rows)], GT)


def ids(df, col="det_id"):
    return sorted(r[col] for r in df.collect())


def value(spark, sql):
    return spark.sql(f"select {sql} as v").first().v


def test_iou_value(spark):
    boxes_sql = "0D a_x1, 0D a_y1, 10D a_x2, 10D a_y2, 5D r_x1, 5D r_y1, 15D r_x2, 15D r_y2"
    out = spark.sql(f"select {boxes_sql}").selectExpr(f"{G.iou('a_')} as v").first().v
    assert out == pytest.approx(25 / 175, abs=1e-6)


def test_greedy_keeps_equal_overlap(spark):
    d = det(spark, (0.9, (0, 0, 10, 10)), (0.8, (0, 0, 10, 5)))
    assert ids(nms.greedy_nms(d, 0.5)) == [0, 1]
    assert ids(nms.greedy_nms(d, 0.49)) == [0]
    assert ids(nms.fast_nms(d, 0.5)) == [0, 1]


def test_greedy_and_fast_differ_on_chains(spark):
    d = det(spark, (0.9, (0, 0, 10, 10)), (0.8, (4, 0, 14, 10)), (0.7, (8, 0, 18, 10)))
    assert ids(nms.greedy_nms(d, 0.3)) == [0, 2]
    assert ids(nms.fast_nms(d, 0.3)) == [0]


def test_average_precision_match_keeps_lowest_index(spark):
    d = det(spark, (0.9, (0, 0, 10, 6)), (0.8, (0, 0, 10, 9)))
    rows = {r.det_id: r for r in matching.match_predictions(d, gt(spark, (0, 0, 10, 10))).collect()}
    assert (rows[0].tp50, rows[1].tp50) == (1, 0)
    assert (rows[0].tp75, rows[1].tp75) == (0, 1)
    pairs = matching.confusion_pairs(d, gt(spark, (0, 0, 10, 10))).collect()
    assert [p.det_id for p in pairs] == [1]


def test_no_fallback_to_second_truth(spark):
    d = det(spark, (0.9, (0, 0, 10, 10)), (0.8, (0, 0, 10, 10)))
    out = matching.match_predictions(d, gt(spark, (0, 0, 10, 10), (0, 0, 10, 8)))
    assert sum(r.tp50 for r in out.collect()) == 1


def test_average_precision_value(spark):
    truth = gt(spark, (0, 0, 10, 10), (100, 0, 110, 10))
    d = det(spark, (0.9, (0, 0, 10, 10)), (0.8, (300, 0, 310, 10)), (0.7, (100, 0, 110, 10)))
    hist = evaluation.confidence_histogram(matching.match_predictions(d, truth))
    ap = evaluation.average_precision(evaluation.cumulative_counts(hist), evaluation.class_truths(truth))
    assert {r.level: r.ap for r in ap.collect()}[50] == pytest.approx(0.828333, abs=1e-6)


def test_average_precision_against_plain_python(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        n, n_gt = int(rng.integers(5, 40)), int(rng.integers(3, 30))
        conf = rng.permutation(1000)[:n] / 1000
        tp = (rng.random(n) < 0.5).astype(int)
        tp[np.cumsum(tp) > n_gt] = 0
        rows = [(0, float(c), *[int(t)] * 10) for c, t in zip(conf, tp)]
        match = spark.createDataFrame(rows, "cls int, conf double, " + ", ".join(f"{c} int" for c in matching.level_columns()))
        truths = spark.createDataFrame([(0, n_gt)], "cls int, n_gt bigint")
        got = evaluation.average_precision(evaluation.cumulative_counts(evaluation.confidence_histogram(match)), truths).first().ap
        order = np.argsort(-conf)
        c = np.cumsum(tp[order])
        rec = np.concatenate([[0], c / n_gt, [1]])
        pre = np.concatenate([[1], c / np.arange(1, n + 1), [0]])
        pre = np.maximum.accumulate(pre[::-1])[::-1]
        x = np.arange(101) * 0.01
        assert got == pytest.approx(np.trapezoid(np.interp(x, rec, pre), x), abs=1e-9)


def test_class_without_predictions_scores_zero(spark):
    truth = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 9.0, 9.0)], GT)
    hist = evaluation.confidence_histogram(matching.match_predictions(det(spark, (0.9, (0, 0, 9, 9))), truth))
    ap = evaluation.average_precision(evaluation.cumulative_counts(hist), evaluation.class_truths(truth)).collect()
    assert {(r.cls, r.ap) for r in ap} == {(5, 0.0)}


def test_strict_confidence(spark):
    df = spark.sql("select 1 as id, array(0.25D, 0.1D) as s")
    assert boxes.score_rows(df, "s", 0.25, False).count() == 0


def test_label_rules_and_duplicates(spark):
    lines = [("a", "0 1.009 0.5 0.1 0.1"), ("b", "0 1.011 0.5 0.1 0.1"), ("c", "0 -0.011 0.5 0.1 0.1"), ("d", "0 0.5 0.5 0.1 0.1"), ("d", "0 0.5 0.5 0.1 0.1")]
    objects = labels_text.parse_lines(spark.createDataFrame(lines, "path string, line string"))
    verdict = {r.path: r for r in labels_text.verdicts(objects, 10).collect()}
    assert [verdict[p].reason for p in "abcd"] == [None, "out of bounds", "negative", None]
    assert verdict["d"].n_duplicates == 1
    assert labels_text.clean_objects(objects, labels_text.verdicts(objects, 10)).count() == 2


def test_label_files_end_to_end(spark, tmp_path):
    (tmp_path / "one.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.3 0.1 0.3 0.4 0.1 0.4\n")
    (tmp_path / "two.txt").write_text("2 0.5 0.5 0.2 0.4\n")
    rows = labels_text.parse_lines(labels_text.read_lines(spark, str(tmp_path))).collect()
    by = {(r.path.rsplit("/", 1)[1], r.cls): r for r in rows}
    assert by["one.txt", 0].is_polygon and by["one.txt", 1].is_polygon and not by["two.txt", 2].is_polygon
    assert by["one.txt", 1].w == pytest.approx(0.2) and by["one.txt", 1].h == pytest.approx(0.3)


def test_voc_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<annotation><filename>a.jpg</filename><size><width>100</width><height>100</height></size><object><name>cat</name><difficult>0</difficult>"
        "<bndbox><xmin>1</xmin><ymin>1</ymin><xmax>11</xmax><ymax>21</ymax></bndbox></object></annotation>"
    )
    r = formats.voc_objects(formats.read_voc(spark, str(tmp_path)), ["cat"]).first()
    assert (r.x, r.y, r.w, r.h) == pytest.approx((0.05, 0.10, 0.10, 0.20))


def test_coco_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"images": [{"id": 1, "width": 100, "height": 50, "file_name": "a.jpg"}], "annotations": ['
        '{"id": 1, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 20], "iscrowd": 0, "segmentation": [[1, 2, 3]]},'
        '{"id": 2, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 20], "iscrowd": 0},'
        '{"id": 3, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 20], "iscrowd": 1, "segmentation": {"counts": "x"}}]}'
    )
    rows = formats.coco_objects(*formats.read_coco(spark, str(tmp_path))).collect()
    assert [(r.cls, r.x, r.y) for r in rows] == [(2, 0.2, 0.4)]


def test_unknown_scene_class_fails(spark):
    lines = spark.createDataFrame([("a", "0 0 1 0 1 1 0 1 spaceship 0")], "path string, line string")
    sizes = spark.createDataFrame([("a", 10, 10)], "path string, width int, height int")
    with pytest.raises(Exception, match="unknown class"):
        formats.dota_objects(lines, sizes).collect()


def test_dataset_description(spark):
    assert formats.class_dimension(spark, {"nc": 2}).count() == 2
    with pytest.raises(ValueError):
        formats.class_dimension(spark, {"names": {0: "a", 2: "b"}})
    splits = formats.split_dimension(spark, {"path": "/d", "train": "a", "validation": "b"}).collect()
    assert {(r.split, r.path) for r in splits} == {("train", "/d/a"), ("val", "/d/b")}
    assert formats.resolve_split(["train", "valid"], "val") == "valid"


def test_letterbox_point(spark):
    _, fy = boxes.point_unmap("0D", "80D", "640", "480", 640.0, 640.0)
    assert value(spark, fy) == 0


def test_number_text(spark):
    for v in (0.4640625, 0.1, 123456.7, 1234567.0, 0.00001234, 0.5, 100.0, 0.0001, -0.25, 1e-4, 0.9999995):
        assert value(spark, general(f"{v!r}D")) == "%g" % v
    for v in (0.4640625, 0.5046875, 0.1234565):
        assert value(spark, fixed_round(f"{v!r}D", 6)) == float("%.6f" % v)


def test_tiles(spark):
    plan = tiles.tile_plan(spark.sql("select 1 as image_id, 1000 as width, 1000 as height"), [600], [100]).collect()
    assert sorted((r.tx1, r.ty1) for r in plan) == [(0, 0), (0, 400), (400, 0), (400, 400)]
    small = tiles.tile_plan(spark.sql("select 1 as image_id, 100 as width, 100 as height"), [600], [100]).collect()
    assert len(small) == 1


def test_polygon_clip_of_a_diamond(spark):
    df = spark.sql("select array(struct(0D as x, -10D as y), struct(10D as x, 0D as y), struct(0D as x, 10D as y), struct(-10D as x, 0D as y)) as polygon, 0 as r_tx1, -5 as r_ty1, 20 as r_tx2, 20 as r_ty2")
    clipped = df.selectExpr(f"{tiles.clip_to_tile()} as p").selectExpr(f"{tiles.polygon_area('p')} as a").first().a
    assert clipped == pytest.approx(100 - 12.5)
    away = df.selectExpr("polygon", "50 as r_tx1", "50 as r_ty1", "60 as r_tx2", "60 as r_ty2").selectExpr(f"{tiles.polygon_area(tiles.clip_to_tile())} as a").first().a
    assert away == 0


def test_crop_rule(spark):
    r = boxes.crop_rectangle(spark.sql("select 10D as x1, 10D as y1, 20D as x2, 20D as y2"), "640", "480").first()
    assert (r.crop_x1, r.crop_y1, r.crop_x2, r.crop_y2) == (4, 4, 25, 25)


def observations(spark, points, track=1, frames=None, cls=0):
    frames = frames or range(1, len(points) + 1)
    return spark.createDataFrame([(0, track, f, cls, float(x), float(y)) for f, (x, y) in zip(frames, points)], OBS)


def test_repetitions(spark):
    obs = observations(spark, [(0, 0)] * 5).selectExpr("*", "array(160, 80, 100, 150, 85)[cast(frame_no - 1 as int)] as angle")
    rows = tracks.repetitions(obs).orderBy("frame_no").collect()
    assert [r.stage for r in rows] == ["up", "down", "down", "up", "down"] and rows[-1].reps == 2


def test_speed(spark):
    points = [(0, 0), (10, 0), (20, 0), (30, 0), (40, 0)]
    assert tracks.speed_lock(observations(spark, points)).first().speed in (53, 54)
    assert tracks.speed_lock(observations(spark, points, frames=[1, 2, 3, 4, 15])).first().speed == 15


def test_line_counter_counts_once(spark):
    rows = tracks.crossings(observations(spark, [(300, 100), (340, 100), (300, 100)]), [(320, 0), (320, 400)]).collect()
    assert [r.direction for r in rows] == ["IN"]


def test_region_edge(spark):
    obs = observations(spark, [(0, 5)])
    square = {"r": [(0, 0), (10, 0), (10, 10), (0, 10)]}
    assert tracks.in_regions(obs, square).count() == 0
    assert tracks.in_regions(obs, square, edge=True).count() == 1


def test_heat_disc(spark):
    obs = spark.sql("select 0L as stream_id, 2D as cx, 2D as cy, 4D as w, 4D as h")
    want = sum((x - 2) ** 2 + (y - 2) ** 2 <= 4 for x, y in itertools.product(range(4), repeat=2))
    total = tracks.heat_rows(obs, 640, 480).selectExpr("sum(heat * len) as t").first().t
    assert total == 2 * want


def test_first_alarm(spark):
    rows = [(0, f) for f, n in ((1, 3), (2, 5), (3, 7)) for _ in range(n)]
    out = tracks.first_alarm(spark.createDataFrame(rows, "stream_id bigint, frame bigint"), 5).collect()
    assert [(r.frame, r.total) for r in out] == [(2, 5)]


def test_validation_quota(spark):
    df = spark.range(25).selectExpr("id", "0 as g")
    out = datasets.ranked_quota(df, "g", "id", "greatest(1, n div 10)", buckets=7)
    assert out.where("picked").count() == 2 and out.count() == 25


def test_keypoint_shape(spark):
    df = spark.sql("select 1 as id, transform(sequence(0, 50), i -> if(i % 3 = 2, 2D, i + 0.5D)) as values")
    assert tuple(datasets.keypoint_shape(df).first()) == (17, 3)


def test_run_length(spark):
    pixels = spark.createDataFrame([(1, 0), (1, 1), (1, 3)], "id bigint, pos bigint")
    out = masks.run_length_text(masks.pixel_runs(pixels, ["id"]), ["id"], 4).first()
    assert list(out.counts) == [0, 2, 1, 1] and read_counts(out.rle) == [0, 2, 1, 1]
    many = [0, 15, 16, 17, 700, 3, 1_000_000, 3, 31, 40_000, 0, 5]
    text = spark.createDataFrame([(many,)], "counts array<bigint>").selectExpr(f"{masks.counts_text()} as rle").first().rle
    assert read_counts(text) == many


def read_counts(text):
    """Counts of a compressed text."""
    out, value, shift = [], 0, 0
    for c in text:
        group = ord(c) - 48
        value |= (group & 31) << shift
        shift += 5
        if group < 32:
            value -= (1 << shift) if group & 16 else 0
            out.append(value + (out[-2] if len(out) > 2 else 0))
            value, shift = 0, 0
    return out


def test_suppression_keeps_all_separate_boxes(spark):
    """2,000 boxes that do not touch all stay, under every rule."""
    from boxwright.operators import nms

    rows = [(1, i, 0, 0.5, 30.0 * (i % 50), 30.0 * (i // 50)) for i in range(2000)]
    det = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double").selectExpr("*", "x1 + 20 as x2", "y1 + 20 as y2")
    assert nms.greedy_nms(det, 0.5).count() == nms.fast_nms(det, 0.5).count() == 2000
    turned = det.selectExpr("image_id", "det_id", "cls", "conf", "x1 + 10 as cx", "y1 + 10 as cy", "20D as w", "20D as h", "0.1D as r")
    assert nms.rotated_nms(turned, 0.5).count() == 2000


def test_assignment_against_brute_force():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        cost = rng.random((n, m))
        best = min(
            sum(cost[i, j] for i, j in pairs) + 0.6 * ((n + m) / 2 - len(pairs))
            for k in range(min(n, m) + 1)
            for rows in itertools.combinations(range(n), k)
            for cols in itertools.permutations(range(m), k)
            for pairs in [list(zip(rows, cols))]
            if all(cost[i, j] <= 0.6 for i, j in pairs)
        )
        got = solve(cost, 0.6)
        assert sum(cost[i, j] for i, j in got) + 0.6 * ((n + m) / 2 - len(got)) == pytest.approx(best)


def test_blocked_scan_equals_plain_window(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id as t", "if(id % 5 = 0, null, id * 7 % 13) as v")
    out = scans.blocked_scan(df, ["k"], ["t"], "t div 17", lags={"p": "v"}, sums={"s": "v"}, maxs={"m": "v"}, lasts={"l": "v"})
    w = "partition by k order by t"
    plain = df.selectExpr("*", f"lag(v) over ({w}) as p", f"coalesce(sum(v) over ({w}), 0) as s", f"max(v) over ({w}) as m", f"last(v) ignore nulls over ({w}) as l")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_rolling_history_equals_plain_window(spark):
    df = spark.range(300).selectExpr("id % 2 as k", "id as t")
    out = scans.rolling_history(df, ["k"], ["t"], "t div 7", "t", 10, "h")
    plain = df.selectExpr("*", "collect_list(t) over (partition by k order by t rows between 9 preceding and current row) as h")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_copies_of_one_box(spark):
    """A third of the rows in one image at one place: linear work, one survivor, one match."""
    d = spark.range(3000).selectExpr(
        "if(id < 1000, 1, id) as image_id", "id as det_id", "0 as cls", "1 - id / 4000D as conf", "10D as x1", "10D as y1", "50D as x2", "50D as y2"
    )
    assert nms.fast_nms(d, 0.5).where("image_id = 1").count() == 1
    assert nms.greedy_nms(d, 0.5).where("image_id = 1").count() == 1
    truth = d.selectExpr("image_id", "det_id as gt_id", "cls", "x1", "y1", "x2", "y2")
    out = matching.match_predictions(d, truth).where("image_id = 1").selectExpr("sum(tp50) as n").first()
    assert out.n == 1


def test_stitch_keeps_every_vertex():
    rings = [np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) + [3 * k, 0] for k in range(3)]
    outline = stitch(rings)
    assert {tuple(p) for r in rings for p in r} == {tuple(p) for p in outline}


def test_stitch_walks_out_and_back():
    """A middle ring is walked from its lower to its higher link and finished on the way back; one linked backwards is turned first."""
    a, b, c = (np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) + [x, 0] for x in (0, 3, 6))
    out = stitch([a, b, c]).tolist()
    assert out == [[1, 0], [1, 1], [0, 1], [0, 0], [1, 0], [3, 0], [4, 0], [6, 0], [7, 0], [7, 1], [6, 1], [6, 0], [4, 0], [4, 1], [3, 1], [3, 0]]
    back = stitch([c, b, a]).tolist()
    assert back[:5] == [[6, 0], [7, 0], [7, 1], [6, 1], [6, 0]] and back[5:7] == [[3, 1], [4, 1]] and back[-4:] == [[4, 1], [4, 0], [3, 0], [3, 1]]
    assert stitch([a]).tolist() == a.tolist()


def test_ks_statistic(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300).round(1), rng.normal(0.3, 1.2, 200).round(1)
    one, two = (spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "value double") for v in (a, b))
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    for blocks in (1, 7, 4096):
        row = datasets.ks_statistic(one, two, "value", blocks).first()
        assert row.ks == pytest.approx(want) and (row.n_train, row.n_live) == (300, 200)
    same = spark.createDataFrame([(1.0,)] * 3, "value double")
    assert datasets.ks_statistic(same, same, "value").first().ks == 0


def test_running_changes_over_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, "up", "down", "down"])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, at int, item string")
    want = {}
    for k in range(3):
        last, n = None, 0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            if v is not None:
                n += last == "up" and v == "down"
                last = v
            want[k, i] = (last, n)
    for size in (1, 4, 1000):
        out = scans.running_changes(df, ["key"], ["at"], f"at div {size}", "item", "_p = 'up' and _v = 'down'", "n", "last")
        assert {(r.key, r["at"]): (r["last"], r.n) for r in out.collect()} == want
    visits = scans.running_changes(df, ["key"], ["at"], "at div 7", "at", "_p is null or _v - _p > 1", "n", "last")
    assert {r.n for r in visits.collect()} == {1}


def test_keypoint_shape_rules(spark):
    def shape(rows, **options):
        return tuple(datasets.keypoint_shape(spark.createDataFrame([([float(x) for x in r],) for r in rows], "values array<double>"), **options).first())

    assert shape([[1.0, 2, 1] * 4]) == (4, 3) and shape([[1.5] * 8]) == (4, 2) and shape([[1.5] * 9]) == (None, None)
    assert shape([[9.0] * 5 + [1.5, 2.5, 2.0] * 2], offset=5) == (2, 3)
    assert shape([[1.0, 2, 1], [1.0, 2]]) == (None, None)
    with pytest.raises(Exception, match="one shape"):
        shape([[1.5] * 9], strict=True)


def test_only_changed_files_are_parsed(spark, tmp_path):
    seen = []

    def parse(files):
        seen.append(sorted(r.path for r in files.collect()))
        return files.selectExpr("path", "length(key) as n")

    def scan(rows, cache, out):
        files = spark.createDataFrame(rows, "path string, key string")
        return sorted(tuple(r) for r in exports.incremental_counts(files, cache and str(tmp_path / cache), parse, str(tmp_path / out)).select("path", "n", "parsed").collect())

    assert scan([("a", "1"), ("b", "22"), ("c", "333")], None, "one") == [("a", 1, True), ("b", 2, True), ("c", 3, True)]
    assert scan([("a", "1"), ("b", "22222"), ("d", "4")], "one", "two") == [("a", 1, False), ("b", 5, True), ("d", 1, True)]
    assert seen == [["a", "b", "c"], ["b", "d"]]


def test_outline_that_leaves_on_three_sides(spark):
    """A polygon far over the image is clipped to it; points outside do not widen a box."""
    rows = [(0, [(-50.0, -50.0), (700.0, -50.0), (700.0, 300.0), (-50.0, 300.0)]), (1, [(600.0, 100.0), (630.0, 100.0), (700.0, 140.0), (600.0, 140.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], "id long, polygon array<struct<x double, y double>>")
    df = df.selectExpr("*", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) as m", "0D as x1", "0D as y1", "100D as x2", "100D as y2")
    got = {r.id: (r.x1, r.y1, r.x2, r.y2, [(p.x, p.y) for p in r.polygon]) for r in augment.perspective_outlines(df, "640D", "480D").collect()}
    assert 0 not in got  # all four points lie on the border once clipped, so no box is left
    assert got[1][:4] == (600.0, 100.0, 630.0, 140.0) and got[1][4] == [(600.0, 100.0), (630.0, 100.0), (630.0, 140.0), (600.0, 140.0)]


def test_jpeg_header():
    sof = b"\xff\xc0\x00\x0b\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x01\x00\x00"
    good = b"\xff\xd8" + sof + b"\x00" * 12 + b"\xff\xd9"
    assert media._header(good) == ("jpeg", 40, 30, True)
    assert media._header(good[:-2])[3] is False
    assert media._header(b"GIF89a")[0] is None


def test_documents_with_equal_ids(spark, tmp_path):
    """Image ids of two files are different images, and so are their indexes."""
    for name, box in (("a", 10), ("b", 20)):
        (tmp_path / "coco").mkdir(exist_ok=True)
        (tmp_path / "coco" / f"{name}.json").write_text(
            f'{{"images": [{{"id": 1, "width": 100, "height": 50, "file_name": "{name}.jpg"}}], "annotations": [{{"id": 1, "image_id": 1, "category_id": 3,'
            f' "bbox": [{box}, 10, 20, 20], "iscrowd": 0, "segmentation": [[{box}, 10, {box}, 20, 30, 20], [1, 2, 3]]}}]}}'
        )
        (tmp_path / "seq").mkdir(exist_ok=True)
        (tmp_path / "seq" / f"{name}.json").write_text(
            f'{{"images": [{{"name": "{name}.jpg", "sid": 0}}], "annotations": [{{"image_id": 0, "category_id": 1, "bbox": [{box}, 0, 192, 120]}}], "seq_dirs": ["s"]}}'
        )
    images, anns = formats.read_coco(spark, str(tmp_path / "coco"))
    assert sorted((r.file_name, r.x) for r in formats.coco_objects(images, anns).collect()) == [("a.jpg", 0.2), ("b.jpg", 0.3)]
    outlines = sorted((r.file_name, r.part, r.coords) for r in formats.coco_polygons(images, anns).collect())
    assert outlines == [("a.jpg", 0, [0.1, 0.2, 0.1, 0.4, 0.3, 0.4]), ("b.jpg", 0, [0.2, 0.2, 0.2, 0.4, 0.3, 0.4])]
    found = formats.argoverse_objects(*formats.read_argoverse(spark, str(tmp_path / "seq"))).collect()
    assert sorted(r.path for r in found) == ["s/a.jpg", "s/b.jpg"]


def test_greedy_chain_and_copies(spark):
    """A chain of overlapping boxes alternates; copies follow their first; boxes without area never meet."""
    rows = [(0, 0, i, 0.9 - i / 1000, 10.0 * i, 0.0, 10.0 * i + 20, 20.0) for i in range(40)]
    rows += [(0, 0, 100 + i, 0.5, 0.0, 500.0, 20.0, 520.0) for i in range(30)] + [(0, 0, 200 + i, 0.4, 700.0, 0.0, 700.0, 9.0) for i in range(3)]
    det = spark.createDataFrame(rows, "image_id long, cls int, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    want = list(range(0, 40, 2)) + [100, 200, 201, 202]
    for limit in (0.3, 0.05):
        out = nms.greedy_nms(det, limit).collect()
        assert sorted(r.det_id for r in out) == want
        assert sorted(r.det_id for r in nms.greedy_nms(det, limit, small=4).collect()) == want
    capped = sorted((r["rank"], r.det_id) for r in nms.greedy_nms(det, 0.3, max_det=3).collect())
    assert capped == [(1, 0), (2, 2), (3, 4)]


def _plain_greedy(rows, limit):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        def overlap(k, r=r):
            w, h = min(r[6], k[6]) - max(r[4], k[4]), min(r[7], k[7]) - max(r[5], k[5])
            i = max(w, 0) * max(h, 0)
            return i / ((r[6] - r[4]) * (r[7] - r[5]) + (k[6] - k[4]) * (k[7] - k[5]) - i)

        if all(k[:2] != r[:2] or overlap(k) <= limit for k in kept):
            kept.append(r)
    return sorted(k[2] for k in kept)


def test_greedy_of_dense_groups(spark):
    """Groups beyond the fold's bound fall into components; components beyond it are peeled in rounds."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 200), rng.choice([2.0, 30.0, 60.0]), rng.choice([2.0, 25.0, 50.0])
        rows.append((1, i % 2, i, round(rng.random(), 2), x, y, x + w, y + h))
    det = spark.createDataFrame(rows, "image_id long, cls int, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    for limit in (0.05, 0.3):
        for small in (8, 40, 2048):
            assert sorted(r.det_id for r in nms.greedy_nms(det, limit, small=small).collect()) == _plain_greedy(rows, limit), (limit, small)


def test_dense_keys_meet_on_levels(spark):
    """The grid of dense keys finds the pairs of the plain join, over boxes of very different sizes."""
    rng = random.Random(8)
    rows = []
    for i in range(200):
        side = 10 ** rng.uniform(-2, 4)
        x, y = rng.uniform(-3, 3) * side, rng.uniform(-3, 3) * side
        for j in range(3):
            rows.append((1, i * 3 + j, x + side * 0.02 * j, y, x + side * (1 + 0.02 * j), y + side * rng.uniform(0.95, 1.3)))
    boxes = spark.createDataFrame(rows, "image_id long, id long, x1 double, y1 double, x2 double, y2 double")
    for limit in (0.2, 0.5, 0.9):
        for how in ("inner", "left_anti"):
            one, two = (sorted(tuple(r) for r in overlap.iou_join(boxes, boxes, ["image_id"], limit, how, extra="id < r_id", small=n).collect()) for n in (10, 10_000))
            assert one == two and len(one) > 20
    turned = boxes.selectExpr("image_id", "id", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy", "x2 - x1 as w", "y2 - y1 as h", "id % 7 / 3D as r").where("w > 1")
    one, two = (sorted((r.id, r.r_id) for r in nms.rotated_join(turned, turned, ["image_id"], 0.4, small=n).collect()) for n in (10, 10_000))
    assert one == two and len(one) > 200


def test_leading_share(spark):
    for n in (0, 1, 3, 101):
        paths = spark.createDataFrame([(f"p{i * 37 % 101:03d}",) for i in range(n)], "path string")
        want = sorted(r.path for r in paths.collect())[: round(n * 0.5)]
        assert sorted(r.path for r in labels_text.leading_share(paths, 0.5).collect()) == want


def _best_total(pairs):
    """Largest total of a one-to-one choice, by trying all."""
    lefts = sorted({p[0] for p in pairs})

    def best(k, used):
        if k == len(lefts):
            return 0.0
        here = [s + best(k + 1, used | {v}) for u, v, s in pairs if u == lefts[k] and v not in used]
        return max([best(k + 1, used), *here])

    return best(0, frozenset())


def _random_pairs(rng, n, m, share):
    return [(i, j, round(rng.random(), rng.choice([1, 3]))) for i in range(n) for j in range(m) if rng.random() < share]


def test_sparse_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(150):
        pairs = _random_pairs(rng, rng.randint(1, 6), rng.randint(1, 6), rng.choice([0.3, 0.7, 1]))
        if pairs:
            u, v, s = (np.array(c) for c in zip(*pairs, strict=True))
            chosen = solve_pairs(u, v, s)
            assert len({u[k] for k in chosen}) == len({v[k] for k in chosen}) == len(chosen)
            assert sum(s[k] for k in chosen) == pytest.approx(_best_total(pairs))


def test_assignment_of_small_and_large_groups(spark):
    """Groups over the bound are cut into components, components over it go to the auction."""
    rng = random.Random(2)
    rows, want = [], {}
    for image in range(3):
        for part in range(4):
            pairs = _random_pairs(rng, 5, 5, 0.5)
            rows += [(image, u + 10 * part, v + 10 * part, s) for u, v, s in pairs]
            want[image] = want.get(image, 0) + _best_total(pairs)
    df = spark.createDataFrame(rows, "image_id long, u long, v long, score double")
    for small in (1000, 30):
        got = best_pairs(df, ["image_id"], small).collect()
        assert len({(r.image_id, r.u) for r in got}) == len({(r.image_id, r.v) for r in got}) == len(got)
        assert {i: sum(r.score for r in got if r.image_id == i) for i in want} == pytest.approx(want)
    one = df.where("image_id = 0 and u < 10")
    got = best_pairs(one, ["image_id"], small=3, least=0.01).collect()
    assert len({r.u for r in got}) == len({r.v for r in got}) == len(got)
    total = _best_total([(r.u, r.v, r.score) for r in one.collect()])
    assert total - 0.1 <= sum(r.score for r in got) <= total + 1e-9


def test_assignment_of_one_image_of_thousands():
    """5,000 boxes of one image, each overlapping a few others, in one task."""
    rng = np.random.default_rng(3)
    u = np.repeat(np.arange(5000), 6)
    v = (u + rng.integers(-8, 9, len(u))).clip(0)
    s = rng.random(len(u))
    chosen = solve_pairs(u, v, s)
    assert len(set(u[chosen])) == len(set(v[chosen])) == len(chosen) > 4000


def test_similarity_tree_prunes_clusters(spark):
    """Clustered vectors: exact counts and lists by far fewer comparisons than all pairs; a wide radius makes no copies of rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 8)) * 5
    v = np.concatenate([centres[np.arange(400) % 20] + rng.normal(size=(400, 8)) * 0.1, centres[:5], centres[:5]])
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    for r in search.similarity_counts(df, 0.4, 50, leaf=40).collect():
        near = gap[r.vec_id][gap[r.vec_id] < 0.4]
        assert r.n_similar == min(len(near), 50)
        assert r.nearest_dist == (pytest.approx(near.min()) if len(near) else None)
    for r in search.similarity_lists(df, 0.4, 6, leaf=40).collect():
        near = [j for j in np.lexsort([np.arange(len(v)), gap[r.vec_id].round(9)]) if gap[r.vec_id][j] < 0.4]
        assert list(r.similar) == near[:6]
    unique = df.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumnRenamed("embedding", "v")
    left, right = search.pivot_tree(unique, 0.4, 40)
    work = search._sizes(left, right, "cell").agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    assert left.count() == 405 and work < 405**2 / 8
    left, right = search.pivot_tree(unique, 100.0, 40)
    assert left.count() == right.count() == 405


def test_media_of_files_folders_and_patterns(spark, tmp_path):
    for name in ("a.jpg", "b.txt", "sub/c.MP4", "sub/d.png", "more/e.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = media.find_media(spark, [str(tmp_path / "a.jpg"), str(tmp_path / "sub"), str(tmp_path / "mo*" / "*.png")])
    assert sorted((r.path.split("/")[-1], r.media_type) for r in found.collect()) == [("a.jpg", "image"), ("c.MP4", "video"), ("d.png", "image"), ("e.png", "image")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        media.find_media(spark, [str(tmp_path / "none.jpg")]).count()


def test_hull_and_region_rows(spark):
    assert set(G.convex_hull([(0, 0), (4, 0), (2, 1), (4, 4), (0, 4), (0, 2)])) == {(0, 0), (4, 0), (4, 4), (0, 4)}
    obs = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 1.0, 1.0), (1, 3, 1.0, 1.0), (0, 4, 9.0, 1.0)], "stream_id long, frame_no long, cx double, cy double")
    square = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))]
    regions = spark.createDataFrame([(0, "open", square, False), (0, "closed", square, True)], "stream_id long, region string, points array<struct<x double, y double>>, edge boolean")
    assert sorted((r.frame_no, r.region) for r in tracks.in_region_table(obs, regions).collect()) == [(1, "closed"), (2, "closed"), (2, "open")]


def test_masks_meet_over_stretches(spark):
    """Long runs share many stretches and count once."""
    one = spark.createDataFrame([(0, 1, 100, 500), (0, 2, 700, 10)], "image_id int, a int, start long, len long")
    two = spark.createDataFrame([(0, 8, 0, 300), (0, 9, 590, 115)], "image_id int, b int, start long, len long")
    got = {(r.a, r.b): r.inter for r in masks.mask_iou(one, two, ["image_id"], "a", "b", 1000).collect()}
    assert got == {(1, 8): 200, (1, 9): 10, (2, 9): 5}


def test_manifest_key_of_large_lengths(spark):
    """Lengths whose sum passes 64 bits make a key, the same in any order, and another one when a length changes."""
    rows = [(f"p{i}", 2**62 + i) for i in range(6)] * 3
    key = lambda some: exports.manifest_key(spark.createDataFrame(some, "path string, length long")).first().key
    assert key(rows) == key(rows[::-1]) != key([*rows[:-1], ("p5", 7)])
    small = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "path string, length long")
    assert exports.manifest_key(small).first().key == "88c328073611d1c21b449320b23cff9d2034f594b39b3d1f5d75ded5ce4fd870"


def test_similarity_in_tiles_of_any_vectors(spark):
    """Pairs met in tiles are those of all pairs: copies, several lengths, holes, null ids and ties; no tile gives more than it needs."""
    rng = np.random.default_rng(3)
    v = [list(x) for x in rng.normal(size=(60, 6))] + [list(x) for x in rng.normal(size=(30, 3))] + [[float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [], None, [0.0, 0.0], [3e200, 0.0]]
    v += [v[0], v[0], v[70], *[[x, 0.0, 0.0, 0.0, 0.0, 9.0] for x in (0.0, 1.0, -1.0, 2.0)]]
    rows = [(i, [None if y is None else float(y) for y in x] if x is not None else None) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def gap(i, j):
        a, b = v[i], v[j]
        if a is None or b is None or len(a) != len(b) or None in (*a, *b):
            return np.inf
        d = np.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))
        return d if d < 1.9 else np.inf

    firsts = df.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumnRenamed("embedding", "v")
    side = firsts.selectExpr("0L as cell", "rep", "n", "v")
    reps = [r.rep for r in firsts.collect()]
    want = {(i, j): gap(i, j) for i in reps for j in reps if i != j and gap(i, j) < 1.9}
    for block in (7, 4096):
        got = {(r.rep, r.r_rep): r.dist for r in search.met_in_tiles(side, side, 1.9, block=block).collect()}
        assert got.keys() == want.keys() and len(want) > 50 and all(got[p] == pytest.approx(want[p]) for p in got)
    assert search.met_in_tiles(side, side, 1.9, totals=True).count() == len({i for i, _ in want})
    for r in search.similarity_lists(df, 1.9, 3).collect():
        near = sorted((round(gap(r.vec_id, j), 9), j) for j in range(len(v)) if j != r.vec_id and gap(r.vec_id, j) < 1.9)
        assert list(r.similar) == [j for _, j in near[:3]], r.vec_id
    assert search.met_in_tiles(side.limit(0), side.limit(0), 1.0).count() == 0


def test_wide_similarity_moves_few_copies(spark, monkeypatch):
    """A cell that pivots cannot split: its vectors are not written again, left rows move once and right rows to few tiles; results are whole."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype("f4").astype(float)
    written, moved = [], []
    write, arrow = search.materialize, type(df).mapInArrow
    monkeypatch.setattr(search, "materialize", lambda x: written.append(x.count() if "v" in x.columns else 0) or write(x))
    monkeypatch.setattr(type(df), "mapInArrow", lambda x, *a: moved.append(x.count()) or arrow(x, *a))
    monkeypatch.setattr(search, "HELD", 2000)
    met = search.met_in_tiles
    monkeypatch.setattr(search, "met_in_tiles", lambda *a, **b: met(*a, **b, block=10))
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    lists = search.similarity_lists(df, 2.5, 4, leaf=30).collect()
    assert len(lists) == 300
    for r in lists:
        near = [j for j in np.lexsort([np.arange(300), gap[r.vec_id].round(9)]) if gap[r.vec_id][j] < 2.5]
        assert list(r.similar) == near[:4]
    counts = search.similarity_counts(df, 2.5, 4, leaf=30).collect()
    assert len(counts) == 300
    for r in counts:
        near = gap[r.vec_id][gap[r.vec_id] < 2.5]
        assert r.n_similar == min(len(near), 4) and r.nearest_dist == (pytest.approx(near.min()) if len(near) else None)
    assert sum(written) == 2 * 300 and len(moved) == 2 and max(moved) <= 300 * (1 + search.TILES)


def test_totals_stop_at_enough(spark):
    """With ``enough`` a row's weights are counted to that number at least, its least distance stays exact."""
    v = np.random.default_rng(2).normal(size=(200, 4))
    side = spark.createDataFrame([(0, i, 1, [float(y) for y in x]) for i, x in enumerate(v)], "cell long, rep long, n long, v array<double>")
    whole = {r.rep: r for r in search.met_in_tiles(side, side, 3.0, totals=True).collect()}
    few = {r.rep: r for r in search.met_in_tiles(side, side, 3.0, totals=True, enough=3, block=20).collect()}
    assert whole.keys() == few.keys() and all(min(few[i].near, 3) == min(r.near, 3) and few[i].best == r.best for i, r in whole.items())


def test_packed_masks_meet_as_their_runs_do(spark):
    """Packed masks overlap as single runs do: across tiles of columns, with repeated ids and empty boxes, in fewer rows."""
    rng = random.Random(4)
    rows = []
    for i in range(150):
        x, y = rng.randrange(600), rng.randrange(400)
        rows.append((i % 3, rng.randrange(40), float(x), float(y), float(x + rng.randrange(300)), float(y + rng.randrange(200))))
    boxes_ = spark.createDataFrame(rows, "image_id int, m int, x1 double, y1 double, x2 double, y2 double")
    others = boxes_.selectExpr("image_id", "m + 100 as n", "y1 as x1", "x1 * 0.5D as y1", "y1 + 200 as x2", "x1 * 0.5D + 90 as y2")
    runs = masks.mask_iou(masks.box_runs(boxes_, "m", 80, 60, 8), masks.box_runs(others, "n", 80, 60, 8), ["image_id"], "m", "n", 60)
    one, two = masks.box_masks(boxes_, "m", 80, 60, 8), masks.box_masks(others, "n", 80, 60, 8)
    got = {tuple(r) for r in masks.packed_iou(one, two, ["image_id"], "m", "n", 60).collect()}
    assert got == {tuple(r) for r in runs.collect()} and len(got) > 300
    assert one.count() <= 150 < masks.box_runs(boxes_, "m", 80, 60, 8).count() / 5


def test_masks_of_a_key_move_once(spark, monkeypatch):
    """Masks of a key meet behind one exchange a side: runs of any shape, that repeat, touch or span columns, repeated and null ids, crowded keys."""
    rng = random.Random(8)
    rows = lambda n: [(rng.choice([0, 1, 2, None]), rng.choice([*range(30), None]), [(rng.randrange(900), rng.choice([0, 3, 7, 25, 70])) for _ in range(rng.randrange(6))]) for _ in range(n)]
    schema = "image_id int, {} int, runs array<struct<start bigint, len bigint>>"
    a, b, common, areas = rows(120), rows(90), {}, [{}, {}]
    for side, some in zip(areas, (a, b), strict=True):
        for image, i, runs in some:
            side[image, i] = side.get((image, i), 0) + sum(n for _, n in runs)
    for image, i, left in a:
        for other, j, right in b:
            shared = sum(max(0, min(p + n, q + k) - max(p, q)) for p, n in left for q, k in right)
            if image == other and None not in (image, i, j) and shared:
                common[image, i, j] = common.get((image, i, j), 0) + shared
    want = sorted((*k, x, x / (areas[0][k[:2]] + areas[1][k[0], k[2]] - x + 1e-7)) for k, x in common.items())
    one, two = spark.createDataFrame(a, schema.format("m")), spark.createDataFrame(b, schema.format("n"))
    for limit in (4096, 25):
        monkeypatch.setattr(overlap, "CROWD", limit)
        assert sorted(tuple(r) for r in masks.packed_iou(one, two, ["image_id"], "m", "n", 20).collect()) == want and len(want) > 200
    monkeypatch.setattr(overlap, "CROWD", 4096)
    assert physical(masks.packed_iou(one, two, ["image_id"], "m", "n", 20)).count("Exchange hashpartitioning") == 2


def test_keypoints_of_an_image_move_once(spark, monkeypatch):
    """Objects meet behind one exchange a side: repeated and null ids, other classes, unlabelled, missing and null points, crowded images."""
    rng = random.Random(9)
    point = lambda: rng.choice([None, *[(float(rng.randrange(60)), float(rng.randrange(60)), rng.choice([0, 1, 2, None]))] * 12])
    made = lambda n: [(rng.choice([0, 1, None]), rng.choice([0, 1, None]), rng.choice([*range(40), None]), [point() for _ in range(rng.choice([2, 3, 3, 3]))]) for _ in range(n)]
    kpts = "kpts array<struct<x double, y double, v int>>"
    d = spark.createDataFrame(made(200), f"image_id long, cls int, det_id long, {kpts}")
    g = spark.createDataFrame([(*r, rng.choice([400.0, 9000.0, 90000.0, None])) for r in made(150)], f"image_id long, cls int, gt_id long, {kpts}, area double")
    sigmas, got = [0.05, 0.07, 0.1], []
    for limit in (4096, 10):
        monkeypatch.setattr(overlap, "CROWD", limit)
        got.append({(r.image_id, r.det_id, r.r_gt_id): round(r.oks, 9) for r in keypoints.oks_join(d, g, ["image_id", "cls"], sigmas, 0.3).collect()})
    assert got[0] == got[1] and len(got[0]) > 100
    monkeypatch.setattr(overlap, "CROWD", 4096)
    assert physical(keypoints.oks_join(d, g, ["image_id", "cls"], sigmas, 0.3)).count("Exchange hashpartitioning") == 2


def test_pixel_runs_over_words_and_blocks(spark):
    """Runs cross words and blocks whole; a position may come twice; keys may be null."""
    spans = {("a", 0): [(0, 1), (62, 130), (65530, 70), (131072, 64)], ("a", 1): [(5, 59), (128, 1)], (None, 1): [(63, 2), (66, 62)]}
    rows = [(*k, p) for k, runs in spans.items() for s, n in runs for p in range(s, s + n)]
    df = spark.createDataFrame(rows + rows[::3], "image_id string, cls int, pos long").repartition(5)
    got = {(r.image_id, r.cls, r.start, r.len) for r in masks.pixel_runs(df, ["image_id", "cls"]).collect()}
    assert got == {(*k, s, n) for k, runs in spans.items() for s, n in runs}


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outlines_are_moved_once(spark):
    square = "array(struct(10D as x, 10D as y), struct(50D as x, 10D as y), struct(50D as x, 40D as y), struct(10D as x, 40D as y)) as polygon"
    df = spark.sql(f"select id, 10D as x1, 10D as y1, 50D as x2, 40D as y2, {square}, array(1D, 0D, 5D, 0D, 1D, 0D, 0D, 0D, 1D) as m from range(1)")
    out = augment.perspective_outlines(df, "640D", "480D")
    r = out.first()
    assert (r.x1, r.y1, r.x2, r.y2, [(p.x, p.y) for p in r.polygon]) == (15, 10, 55, 40, [(15, 10), (55, 10), (55, 40), (15, 40)])
    # the projection, the clamp to the image and the cut stand in the plan once each
    assert plan_text(out).count("transform(") <= 3


def test_tiles_with_outlines_that_wind_twice(spark):
    star = [(0, 0), (4, 0), (4, 4), (0, 4)] * 2
    rows = [(1, 1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (1, 2, [(float(x) + 8, float(y)) for x, y in star]), (1, 3, [(9.0, 0.0), (13.0, 0.0), (13.0, 4.0)])]
    objects = spark.createDataFrame(rows, "image_id bigint, gt_id bigint, polygon array<struct<x: double, y: double>>")
    plan = spark.sql("select 1L as image_id, 0L as tx1, 0L as ty1, 11L as tx2, 9L as ty2")
    out = tiles.tiles_with_objects(plan, objects)
    assert sorted((r.gt_id, round(r.share, 6)) for r in out.collect()) == [(1, 0.9), (2, 0.75)]
    # a pair is tested on its hull before the outline is clipped
    assert "_turns" in plan_text(out)


def test_match_reads_its_pairs_once(spark):
    d = det(spark, (0.9, (0, 0, 10, 10)), (0.8, (0, 0, 10, 9)))
    spread = d.union(d.selectExpr("cast(null as bigint) as image_id", "det_id", "cls", "conf", "x1", "y1", "x2", "y2"))
    out = matching.match_predictions(spread, gt(spark, (0, 0, 10, 10)))
    assert sorted((r.image_id or 0, r.det_id, r.tp50) for r in out.collect()) == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    assert "isnotnull(image_id" not in plan_text(matching.match_levels(spread.selectExpr("*", "0L as gt_id", "0.5D as iou")))


def test_match_moves_each_box_once(spark, monkeypatch):
    """Images are matched behind one exchange a side; an image of many boxes, copies, null images, classes and ids give the rows of the spread match."""
    rng = random.Random(5)
    dets, truths = [], []
    for i in range(300):
        x, y = rng.randrange(60), rng.randrange(60)
        image, cls = rng.choice([0, 0, 1, 2, 3, None]), rng.choice([0, 1, None])
        dets.append((image, i, cls, 0.5, float(x), float(y), x + 40.0, y + 40.0))
        truths.append((image, rng.choice([i, i, None]), rng.choice([cls, 0]), x + 3.0, y + 1.0, x + 41.0 + rng.randrange(9), y + 42.0))
    d, g = spark.createDataFrame(dets + dets[:20], DET), spark.createDataFrame(truths + truths[:30], GT)
    want = sorted(map(str, matching.match_levels(matching.best_truth(d, g, ["image_id", "cls"], 0.5)).collect()))
    for limit in (4096, 60):
        monkeypatch.setattr(overlap, "CROWD", limit)
        out = matching.match_predictions(d, g)
        assert sorted(map(str, out.collect())) == want and len(want) == 300
    monkeypatch.setattr(overlap, "CROWD", 4096)
    assert sum(r.tp50 for r in out.collect()) > 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert physical(matching.match_predictions(d, g)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlap_index_of_nested_masks(spark):
    runs = spark.createDataFrame([(1, 1, 0, 8), (1, 2, 2, 3), (1, 3, 2, 3), (1, 4, 7, 0), (1, 1, 10, 5)], "image_id bigint, mask_id bigint, start bigint, len bigint")
    shown = masks.overlap_index(runs, masks.mask_areas(runs, "image_id", "mask_id"), 10)
    got = sorted((r.col, r.s0, r.e0, r.mask_id) for r in shown.collect())
    assert [g for g in got if g[1] < g[2]] == [(0, 0, 2, 1), (0, 2, 5, 3), (0, 5, 7, 1), (0, 7, 8, 1), (1, 10, 15, 1)]
    assert plan_text(shown).count("Join") == 1


def test_packed_masks_have_the_text_of_their_runs(spark):
    boxes_ = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 30.0), (1, 2, 8.0, 100.0, 639.0, 479.0)], "image_id bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double")
    one = masks.run_length_text(masks.box_runs(boxes_, "det_id", 80, 60, 8), ["image_id", "det_id"], 4800)
    two = masks.run_length_text(masks.box_masks(boxes_, "det_id", 80, 60, 8), ["image_id", "det_id"], 4800)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_short_counts_text(spark):
    counts = [0, 15, 16, 31, 526, 543, 1055, 0, 5000, 70000, 3]
    steps = [c - counts[i - 2] if i > 2 else c for i, c in enumerate(counts)]

    def text(d):
        out = ""
        while True:
            low, d = d & 31, d >> 5
            more = not (d == 0 and not low & 16 or d == -1 and low & 16)
            out += chr(48 + low + 32 * more)
            if not more:
                return out

    got = spark.createDataFrame([(counts,)], "counts array<bigint>").selectExpr(f"{masks.counts_text()} as t").first().t
    assert got == "".join(map(text, steps))


def test_outlines_of_many_objects_are_stitched_together(spark):
    rng = np.random.default_rng(5)
    shapes = [(4, 4, 4)] * 6 + [(3,), (3, 5), (4, 3, 6), (5, 3, 4, 3)] * 2
    objects = [[rng.integers(0, 30, (n, 2)).astype(float) for n in shape] for shape in shapes]
    rows = [(k, i, ring[:, 0].tolist(), ring[:, 1].tolist()) for k, rings in enumerate(objects) for i, ring in enumerate(rings)]
    out = augment.stitch_parts(spark.createDataFrame(rows, "object_id bigint, part_no int, xs array<double>, ys array<double>")).collect()
    assert len(out) == len(objects)
    for r in out:
        assert np.array_equal(np.array([r.xs, r.ys]).T, stitch(objects[r.object_id]))
    together = augment.stitch_all([np.stack([o[i] for o in objects[:6]]) for i in range(3)])
    assert all(np.array_equal(together[k], stitch(objects[k])) for k in range(6))


def test_greedy_of_many_groups_at_once():
    rng = np.random.default_rng(3)
    groups = []
    for n in (1, 2, 7, 40, 3):
        low = rng.integers(0, 20, (n, 2)).astype(float)
        high = low + rng.integers(1, 12, (n, 2))
        groups.append((rng.integers(0, 4, n) / 4, rng.permutation(n).astype(np.int64), low[:, 0], low[:, 1], high[:, 0], high[:, 1]))
    got = nms.kept_places(*map(list, zip(*groups)), 0.3)
    for (c, d, *corners), places in zip(groups, got):
        a, b, e, f = corners
        stay = []
        for i in sorted(range(len(c)), key=lambda i: (-c[i], d[i])):
            def iou(j):
                shared = max(min(e[i], e[j]) - max(a[i], a[j]), 0) * max(min(f[i], f[j]) - max(b[i], b[j]), 0)
                return shared / ((e[i] - a[i]) * (f[i] - b[i]) + (e[j] - a[j]) * (f[j] - b[j]) - shared)
            if all(iou(j) <= 0.3 for j in stay):
                stay.append(i)
        assert places.tolist() == stay


def test_pairs_are_solved_from_one_reading(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(1, 1, 1, 0.9), (1, 2, 2, 0.8), (2, 1, 1, 0.9), (2, 1, 2, 0.8), (2, 2, 1, 0.85), (3, 1, 1, 0.0)]
    schema = "image_id bigint, u bigint, v bigint, score double"
    pairs = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    assert sorted(map(tuple, best_pairs(pairs, ["image_id"]).collect())) == [(1, 1, 1, 0.9), (1, 2, 2, 0.8), (2, 1, 2, 0.8), (2, 2, 1, 0.85)]
    assert seen.value == len(rows)


def test_oriented_lines_equal_the_row_by_row_text(spark):
    from boxwright.functions.text import general_list, general_texts

    values = [[0.5, -0.0, 123456.5, 0.1234565, 999998.7], [1e-5, 2.0], [float("nan"), 1.0], [None, 3.25], [-0.000199, 7.5], [1e7], []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v array<double>")
    both = general_texts(df.selectExpr("*", f"array_join({general_list('v')}, ' ') as old"), "v", "new").collect()
    assert all(r.old == r.new for r in both)
    line = exports.oriented_lines(spark.sql("select 3 as cls, 0.25D as conf, 320D as cx, 240D as cy, 64D as w, 48D as h, 0D as r"), "640", "480", conf=True)
    assert line.first().line == line.selectExpr(f"{exports.oriented_line('640', '480', conf=True)} as l").first().l


def test_documents_are_parsed_once(spark, tmp_path):
    from boxwright.plans import sources

    spark.sql("select 10L * id as l_orderkey, id as l_partkey, id as l_suppkey, cast(id % 7 as int) as l_linenumber, 5D as l_quantity, 10D as l_extendedprice from range(1, 60)").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("select 10L * id as o_orderkey, 'x' as o_orderpriority from range(1, 60)").write.parquet(str(tmp_path / "orders.parquet"))
    images, anns = sources.coco_tables(spark, str(tmp_path))
    assert images.select("id").distinct().count() == 59 and anns.select("id").distinct().count() == 59
    assert "from_json" not in plan_text(anns) and "from_json" not in plan_text(images)
