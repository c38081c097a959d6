"""Prompt selection over object tables (masks given as boxes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G


def box_prompt(objects: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per prompt (p_x1.. p_y2 by image), the object with the largest overlap over union."""
    inter = G.intersection("", "p_")
    score = f"{inter} / ({G.area('p_')} + {G.area('')} - {inter})"
    met = objects.join(prompts, "image_id").selectExpr("image_id", "det_id", f"{score} as s", "p_x1", "p_y1", "p_x2", "p_y2")
    return met.groupBy("image_id", "p_x1", "p_y1", "p_x2", "p_y2").agg(F.expr("max(struct(s, -det_id as k)) as b")).selectExpr(
        "image_id", "-b.k as det_id", "b.s as score"
    )


def point_prompts(objects: DataFrame, prompts: DataFrame) -> DataFrame:
    """Ordered point prompts (x, y, label) per image: the last point that touches an object decides.

    With negative points only, everything starts selected. The fold runs over one image's short prompt list.
    """
    hit = "p.x >= x1 and p.x < x2 and p.y >= y1 and p.y < y2"
    start = "forall(points, p -> p.label = 0)"
    picked = f"aggregate(points, {start}, (s, p) -> if({hit}, p.label = 1, s))"
    return objects.join(prompts, "image_id").where(picked).select("image_id", "det_id")
