"""Merges against the tokenizer library, in both forms."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from boxwright.llm import attribution, bpe
from tests.llm import brute

RAW = open(brute.RANK_FILE, "rb").read()
RANKS = attribution.parse_ranks(RAW)
ENC = brute.encoding()
TEXTS = [
    None, "", " ", "\n\n  x", "the theatre's  tea  x\x1c\x1d y\x85z", "a" * 3000, "ab" * 700 + "-" * 200, "naïve ʻokina 漢字 🙂🙂 é", "1234567890" * 30,
    "I'll we've 'tis\t\r\n end ", "the theatre's  tea  x\x1c\x1d y\x85z",
]


def ids_of(words):
    return [RANKS[p] for w in words for p in bpe.fold_merges(w.encode(), RANKS)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_folds_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    words = bpe.regex.findall(bpe.regex_pattern(public_tokenizers.PATTERN), text)
    want = ENC.encode_ordinary(text)
    assert ids_of(words) == want
    assert [RANKS[p] for w in words for p in bpe._fold_long(w.encode(), RANKS)] == want


def test_forms_agree(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    mine = {r.doc_id: (r.n_tokens, r.ids.hex(), r.decoded.hex()) for r in bpe.encode(docs, RAW, public_tokenizers.PATTERN).collect()}
    native = {r.doc_id: (r.n_tokens, r.ids_hex, r.decoded_hex) for r in bpe.encode_native(docs, RAW, public_tokenizers.PATTERN, dictionary=8).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        ids = ENC.encode_ordinary(t or "")
        want[i] = (len(ids), b"".join(x.to_bytes(4, "little") for x in ids).hex(), (t or "").encode().hex())
    assert mine == want
    assert native == want
