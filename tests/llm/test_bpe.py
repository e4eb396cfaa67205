import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from palimpsest.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        return bpe.load_ranks([x for x in f.read().splitlines() if x])


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(ranks):
    h = bpe.PerfectHash(ranks)
    assert h.n == len(ranks) and None not in h.keys and all(h.get(k) == i for k, i in ranks.items())
    assert h.get(b"not a token at all") == -1 and bpe.PerfectHash({}).get(b"") == -1


def test_codec_equals_library(ranks, reference):
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN, memo_limit=50), random.Random(2)
    letters = "ab cd\n\t\x1c\x85\xa0éß字🗺'st1٣²Ⅷ\u200b\u2028\u3000\ufeff\x00$#"
    for text in ["", " ", "<|endoftext|>", "x" * 3000, " " * 500, *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000))]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and codec.decode(ids).decode() == text


def test_query_columns(docs, rows, reference, clashing, empty):
    got = {r["doc_id"]: r for r in bpe.tokenized(docs).collect()}
    for i, t, *_ in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["ids"]) == ids.tobytes() and bytes(got[i]["decoded"]) == (t or "").encode()
    out = bpe.tokenized(clashing)
    assert "theirs" in {r["kept"] for r in out.select("kept").collect()} and dict(out.dtypes)["ids"] == "binary"
    assert bpe.tokenized(empty).count() == 0


def test_decode_alone(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encode(docs, path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: hashlib.sha256(r["decoded"]).hexdigest() for r in bpe.decode(enc, path, public_tokenizers.PATTERN).collect()}
    assert back[3] == back[4] == hashlib.sha256(b"").hexdigest()
