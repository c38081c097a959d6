"""Box, rotated-box and polygon arithmetic as Spark SQL text.

Every builder takes column prefixes or SQL fragments and returns a SQL fragment, so one ``expr`` call carries a
whole formula and stays inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

EPS = "1e-7D"
CORNERS = ("x1", "y1", "x2", "y2")


def area(a: str = "") -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


def intersection(a: str = "", b: str = "r_") -> str:
    """Overlap area of two corner boxes, zero when apart."""
    return (
        f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0D)"
        f" * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0D))"
    )


def iou(a: str = "", b: str = "r_", eps: str = EPS) -> str:
    i = intersection(a, b)
    return f"({i} / ({area(a)} + {area(b)} - {i} + {eps}))"


def iou_above(limit: float, a: str, b: str) -> str:
    """Whether the epsilon-free overlap exceeds a limit; false where neither box has area."""
    i = intersection(a, b)
    return f"({i} > 0 and {i} / ({area(a)} + {area(b)} - {i}) > {limit}D)"


def ioa(a: str = "", b: str = "r_", eps: str = EPS) -> str:
    """Overlap as a share of the second box."""
    return f"({intersection(a, b)} / ({area(b)} + {eps}))"


def iou_family(a: str = "", b: str = "r_") -> dict[str, str]:
    """Generalised, distance and complete IoU of two corner boxes (heights carry eps, as published)."""
    w1, h1 = f"({a}x2 - {a}x1)", f"({a}y2 - {a}y1 + {EPS})"
    w2, h2 = f"({b}x2 - {b}x1)", f"({b}y2 - {b}y1 + {EPS})"
    inter = intersection(a, b)
    union = f"({w1} * {h1} + {w2} * {h2} - {inter} + {EPS})"
    base = f"({inter} / {union})"
    cw = f"(greatest({a}x2, {b}x2) - least({a}x1, {b}x1))"
    ch = f"(greatest({a}y2, {b}y2) - least({a}y1, {b}y1))"
    hull = f"({cw} * {ch} + {EPS})"
    diag = f"({cw} * {cw} + {ch} * {ch} + {EPS})"
    rho = f"((pow({b}x1 + {b}x2 - {a}x1 - {a}x2, 2) + pow({b}y1 + {b}y2 - {a}y1 - {a}y2, 2)) / 4)"
    v = f"({4 / math.pi**2!r}D * pow(atan({w2} / {h2}) - atan({w1} / {h1}), 2))"
    return {
        "iou": base,
        "giou": f"({base} - ({hull} - {union}) / {hull})",
        "diou": f"({base} - {rho} / {diag})",
        "ciou": f"({base} - ({rho} / {diag} + {v} * ({v} / ({v} - {base} + 1 + {EPS}))))",
    }


def covariance(a: str) -> dict[str, str]:
    """Gaussian covariance terms of the rotated box whose columns carry prefix ``a``."""
    sw, sh = f"({a}w * {a}w / 12)", f"({a}h * {a}h / 12)"
    c, s = f"cos({a}r)", f"sin({a}r)"
    return {
        "va": f"({sw} * {c} * {c} + {sh} * {s} * {s})",
        "vb": f"({sw} * {s} * {s} + {sh} * {c} * {c})",
        "vc": f"(({sw} - {sh}) * {c} * {s})",
    }


def probiou(a: str = "", b: str = "r_") -> str:
    """Hellinger similarity of two rotated boxes from centres and covariance columns (cx, cy, va, vb, vc)."""
    sa, sb, sc = (f"({a}{v} + {b}{v})" for v in ("va", "vb", "vc"))
    dx, dy = f"({a}cx - {b}cx)", f"({a}cy - {b}cy)"
    det = f"({sa} * {sb} - {sc} * {sc})"
    t1 = f"(({sa} * {dy} * {dy} + {sb} * {dx} * {dx}) / ({det} + {EPS}) * 0.25D)"
    t2 = f"(-{sc} * {dx} * {dy} / ({det} + {EPS}) * 0.5D)"
    d1, d2 = (f"greatest({p}va * {p}vb - {p}vc * {p}vc, 0D)" for p in (a, b))
    t3 = f"(ln({det} / (4 * sqrt({d1} * {d2}) + {EPS}) + {EPS}) * 0.5D)"
    return f"(1 - sqrt(1 - exp(-least(greatest({t1} + {t2} + {t3}, {EPS}), 100D)) + {EPS}))"


def rotated_corners(a: str = "") -> list[str]:
    """Eight corner coordinates of (cx, cy, w, h, r), starting at the (+w, +h) corner and going round."""
    ux, uy = f"{a}w / 2 * cos({a}r)", f"{a}w / 2 * sin({a}r)"
    vx, vy = f"-{a}h / 2 * sin({a}r)", f"{a}h / 2 * cos({a}r)"
    signs = (("+", "+"), ("+", "-"), ("-", "-"), ("-", "+"))
    out = []
    for su, sv in signs:
        out += [f"({a}cx {su} ({ux}) {sv} ({vx}))", f"({a}cy {su} ({uy}) {sv} ({vy}))"]
    return out


def clamp(v: str, lo: str, hi: str) -> str:
    return f"least(greatest({v}, {lo}), {hi})"


def in_polygon(x: str, y: str, points: Sequence[tuple[float, float]], edge: bool = False) -> str:
    """Point in polygon by ray casting; ``edge`` says whether the boundary counts as inside."""
    flips, borders = [], []
    n = len(points)
    for i, (ax, ay) in enumerate(points):
        bx, by = points[(i + 1) % n]
        cross = f"(({bx - ax}D) * ({y} - {ay}D) - ({by - ay}D) * ({x} - {ax}D))"
        borders.append(
            f"({cross} = 0 and {x} between {min(ax, bx)}D and {max(ax, bx)}D"
            f" and {y} between {min(ay, by)}D and {max(ay, by)}D)"
        )
        if ay != by:
            flips.append(
                f"if(({ay}D > {y}) <> ({by}D > {y}) and {x} < ({bx - ax}D) * ({y} - {ay}D) / ({by - ay}D) + {ax}D, 1, 0)"
            )
    inside = f"(({' + '.join(flips)}) % 2 = 1)"
    on_edge = f"({' or '.join(borders)})"
    return f"({inside} or {on_edge})" if edge else f"({inside} and not {on_edge})"


def convex_hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull of a region's points, in order; points on its sides are left out."""
    def half(ordered: list[tuple[float, float]]) -> list[tuple[float, float]]:
        chain: list[tuple[float, float]] = []
        for x, y in ordered:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]):
                chain.pop()
            chain.append((x, y))
        return chain[:-1]

    ordered = sorted(set(points))
    return ordered if len(ordered) < 3 else half(ordered) + half(ordered[::-1])


def in_polygon_column(x: str, y: str, points: str, edge: str) -> str:
    """As in_polygon for a column of array<struct<x,y>>; ``edge`` is a boolean SQL fragment."""
    last = f"{points}[size({points}) - 1]"
    pairs = f"zip_with({points}, concat(array({last}), slice({points}, 1, size({points}) - 1)), (a, b) -> struct(a.x as ax, a.y as ay, b.x as bx, b.y as by))"
    border = (
        f"exists({pairs}, e -> (e.bx - e.ax) * ({y} - e.ay) = (e.by - e.ay) * ({x} - e.ax)"
        f" and {x} between least(e.ax, e.bx) and greatest(e.ax, e.bx) and {y} between least(e.ay, e.by) and greatest(e.ay, e.by))"
    )
    odd = (
        f"(size(filter({pairs}, e -> (e.ay > {y}) <> (e.by > {y})"
        f" and {x} < (e.bx - e.ax) * ({y} - e.ay) / (e.by - e.ay) + e.ax)) % 2 = 1)"
    )
    return f"(({odd} and not {border}) or ({border} and {edge}))"


def orient(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def segments_cross(p1, p2, q1, q2) -> str:
    """Whether two closed segments meet, touching included; each end is a pair of SQL fragments."""
    d1, d2 = orient(q1, q2, p1), orient(q1, q2, p2)
    d3, d4 = orient(p1, p2, q1), orient(p1, p2, q2)

    def within(a, b, c) -> str:
        return (
            f"({c[0]} between least({a[0]}, {b[0]}) and greatest({a[0]}, {b[0]})"
            f" and {c[1]} between least({a[1]}, {b[1]}) and greatest({a[1]}, {b[1]}))"
        )

    touch = " or ".join(
        f"({d} = 0 and {within(*ends, c)})"
        for d, ends, c in ((d1, (q1, q2), p1), (d2, (q1, q2), p2), (d3, (p1, p2), q1), (d4, (p1, p2), q2))
    )
    return f"(({d1} * {d2} < 0 and {d3} * {d4} < 0) or {touch})"


def letterbox(w0: str, h0: str, w1: float, h1: float) -> tuple[str, str, str]:
    """Gain and rounded half pads that fit an image into a canvas (rounding is half-even)."""
    gain = f"least({h1}D / {h0}, {w1}D / {w0})"
    pad_x = f"rint(({w1}D - rint({w0} * {gain})) / 2 - 0.1D)"
    pad_y = f"rint(({h1}D - rint({h0} * {gain})) / 2 - 0.1D)"
    return gain, pad_x, pad_y
