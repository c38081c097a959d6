"""Plain conversation repair: every edit script by shortest paths over (row, state)."""

import hashlib
import zlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) after the damage; dropped rows leave (conv, None)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        here = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def fault(rows, i):
    turn, role, text = rows[i]
    if not text.strip(SPACE):
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""


def repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults = [fault(rows, i) for i in range(len(rows))]
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    go = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    # best (cost, audit, repaired) to the end, by state, from the last row on
    best = {0: (0, "", ()), 3: (0, "", ()), 2: (2, "I", (("assistant", ""),)), 1: (4, "II", (("user", ""), ("assistant", "")))}
    for (_, role, text), f in zip(reversed(rows), reversed(faults), strict=True):
        cut, base = int(f == "truncated"), {}
        for q in range(4):
            options = [(3 + best[q][0], "D" + best[q][1], best[q][2])]
            if f in ("", "truncated"):
                for letter, cost, name, r in (("K", 0, role, role[:1]), ("R", 2, "user", "u"), ("R", 2, "assistant", "a")):
                    if (r, q) in go:
                        c, a, t = best[go[r, q]]
                        options.append((c + cost + cut, letter + a, ((name, text), *t)))
            base[q] = min(options)
        best = dict(base)
        for _ in range(4):
            for q in range(4):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (r, q) in go:
                        c, a, t = best[go[r, q]]
                        best[q] = min(best[q], (c + 2, "I" + a, ((name, ""), *t)))
    cost, audit, made = best[0]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),  # noqa: B905
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        "made": made,
    }
