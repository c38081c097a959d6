"""Small SQL text builders for the oracle statements."""

from __future__ import annotations


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0.0)"
        f" * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0.0))"
    )


def box_area(a: str) -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


def iou(a: str, b: str, eps: str = "1e-7") -> str:
    i = inter(a, b)
    return f"({i} / ({box_area(a)} + {box_area(b)} - {i} + {eps}))"


LEVELS = "(SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS p)"


def match_ctes(det: str = "v_det", gt: str = "v_gt", prefix: str = "") -> str:
    """Per-level true positives by two ranking steps."""
    return f"""
{prefix}pairs AS (SELECT d.image_id, d.cls, d.det_id, g.gt_id, {iou("d.", "g.")} AS iou
          FROM {det} d JOIN {gt} g ON d.image_id = g.image_id AND d.cls = g.cls),
{prefix}one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, p, det_id ORDER BY iou DESC, gt_id) AS k
        FROM {prefix}pairs, {LEVELS} WHERE iou >= p / 100.0E0) WHERE k = 1),
{prefix}tp AS (SELECT image_id, p, det_id, gt_id FROM (SELECT image_id, p, det_id, gt_id,
        row_number() OVER (PARTITION BY image_id, p, gt_id ORDER BY det_id) AS k FROM {prefix}one) WHERE k = 1)"""


def ap_ctes(det: str = "v_det", gt: str = "v_gt", prefix: str = "", cls: str = "d.cls") -> str:
    """AP per (class, level) by row-level curves, after match_ctes."""
    return f"""
{prefix}rows AS (SELECT d.cls AS cls, p, d.conf, d.image_id, d.det_id, CASE WHEN t.det_id IS NULL THEN 0 ELSE 1 END AS tp
      FROM {det} d CROSS JOIN {LEVELS} LEFT JOIN {prefix}tp t USING (image_id, p, det_id)),
{prefix}truth AS (SELECT cls, count(*) AS n_gt FROM {gt} GROUP BY cls),
{prefix}cum AS (SELECT cls, p, conf, row_number() OVER w AS r, sum(tp) OVER w AS c FROM {prefix}rows
      WINDOW w AS (PARTITION BY cls, p ORDER BY conf DESC, tp DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
{prefix}knots AS (SELECT cls, p, r, c / (n_gt + 1e-16) AS rec, c / r AS prec FROM {prefix}cum JOIN {prefix}truth USING (cls)
      UNION ALL SELECT DISTINCT cls, p, 0, 0.0, 1.0 FROM {prefix}cum
      UNION ALL SELECT DISTINCT cls, p, 1000000000, 1.0, 0.0 FROM {prefix}cum),
{prefix}env AS (SELECT cls, p, r, rec, max(prec) OVER (PARTITION BY cls, p ORDER BY r DESC) AS e FROM {prefix}knots),
{prefix}steps AS (SELECT cls, p, rec, arg_min(e, r) AS e_first, arg_max(e, r) AS e_last FROM {prefix}env GROUP BY cls, p, rec),
{prefix}segs AS (SELECT *, lead(rec) OVER w AS rec2, lead(e_first) OVER w AS e2 FROM {prefix}steps WINDOW w AS (PARTITION BY cls, p ORDER BY rec)),
{prefix}ys AS (SELECT f.cls, f.p, f.k, coalesce(CASE WHEN s.rec2 IS NULL THEN s.e_last
        ELSE s.e_last + (s.e2 - s.e_last) * (f.x - s.rec) / (s.rec2 - s.rec) END, 0.0) AS y
      FROM (SELECT cls, p, k, CASE WHEN k = 100 THEN 1.0E0 ELSE k * 0.01E0 END AS x FROM {prefix}truth, {LEVELS}, (SELECT unnest(range(101)) AS k)) f
      ASOF LEFT JOIN {prefix}segs s ON f.cls = s.cls AND f.p = s.p AND f.x >= s.rec),
{prefix}ap AS (SELECT cls, p AS level, sum(y * CASE WHEN k IN (0, 100) THEN 0.005E0 ELSE 0.01E0 END) AS ap FROM {prefix}ys GROUP BY cls, p)"""
