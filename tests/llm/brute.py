"""Plain Python versions of the query contracts, one text at a time."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in RULES[kind].finditer(text or "") if passes(kind, m.group())]
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def crc_id(doc_id):
    return zlib.crc32(str(doc_id).encode())


def fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints):
    """{fingerprint: root} by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in names}


def quality(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def targets(sizes, weights=(5, 2, 1)):
    """{source: target} by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = float(sum(sizes.values())), {}
    open_ = set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            return full | {s: left * weight[s] / total for s in open_}
        for s in above:
            full[s] = 3.0 * sizes[s]
        left -= sum(full[s] for s in above)
        open_ -= above
    return full


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_digests(enc, text):
    ids = enc.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode())


def word_scores(rows):
    """{row index: (n_tokens, n_known, N, base_score)} for (doc_id, text) rows."""
    train = Counter()
    for doc_id, text in rows:
        if crc_id(doc_id) % 7 != 2:
            train.update([*WORD.findall(lower(text)), "\n"])
    n, v = sum(train.values()), len(train)
    out = []
    for _, text in rows:
        w = [*WORD.findall(lower(text)), "\n"]
        out.append((len(w), sum(x in train for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
    return out


def top_ten(vectors):
    """[(query, rank, candidate, score)] for {id: components}."""
    v = {i: [math.floor(1024 * x) for x in e] for i, e in vectors.items() if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:10]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)
