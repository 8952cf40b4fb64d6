import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import packing, registry, tokens

CODEC = tokens.Codec(registry.MULTI_RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
TEXTS = ["Hello, world!  Two  spaces\n\n", "", None, "naïve café ß 漢字 🎉 ‍", " " * 3000 + "x", "a" * 5000, "<|endoftext|>", "\x00\x1f\x85 ", "12345 's don't"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_rank_library(text):
    (ids,) = CODEC.encode([text])
    assert ids == TIKTOKEN.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_letters_of_newer_tables():
    for text in ("A\U00018d20뼑", "͸՘", "x꟏1"):
        assert next(CODEC.encode([text])) == TIKTOKEN.encode_ordinary(text)


def test_digests(spark, docs_of):
    got = {r.doc_id: r for r in tokens.digests(docs_of(TEXTS), registry.MULTI_RANKS, P.PATTERN).collect()}
    for k, text in enumerate(TEXTS):
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_frames(spark, docs_of):
    docs = docs_of(TEXTS).withColumn("token_ids", F.lit("mine"))
    coded = tokens.encode(docs, registry.MULTI_RANKS, P.PATTERN)
    rows = coded.collect()
    for r in rows:
        assert r.token_ids == "mine" and (r["token_ends"] or [0])[-1] == len((r.text or "").encode())
    back = tokens.decode(coded, registry.MULTI_RANKS, P.PATTERN, ids="_token_ids")
    assert all(r.decoded == (r.text or "") for r in back.collect())
    cut = spark.createDataFrame([(next(CODEC.encode(["漢"]))[:1],), (None,)], "token_ids array<int>")
    assert {r.decoded for r in tokens.decode(cut, registry.MULTI_RANKS, P.PATTERN).collect()} == {"�", None}
    assert tokens.encode(docs_of([]), registry.MULTI_RANKS, P.PATTERN).count() == 0


def test_packing_ids_are_those_of_the_tokenizers_file():
    own, plain = packing.Encoder(registry.PACK_VOCABULARY, P.PATTERN), Tokenizer.from_file(registry.PACK_VOCABULARY)
    r = random.Random(2)
    texts = [t for t in TEXTS if t is not None] + ["".join(chr(r.choice([r.randrange(32, 600), 32, 10])) for _ in range(60)) for _ in range(400)]
    for text in texts:
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_fills_every_slot_once(counts):
    runs = packing.plan(counts, 32)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, first, offset in runs:
        for k in range(n):
            used[first + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {k: len(v) for k, v in ranks.items()} == counts and all(v == set(range(len(v))) for v in ranks.values())
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 32
    bins: list[int] = []  # best-fit decreasing, piece by piece
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [room for room in bins if room >= length]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else 32) - length)
    assert len(used) == len(bins)


def test_pieces():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack(spark, docs_of):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "be", "gamma", "x1", "é"]) for _ in range(r.choice([0, 1, 5, 60, 60, 60, 700, 5000]))) for _ in range(80)] + [None, None, texts_same := "same " * 30, texts_same]
    ids = [*range(len(texts) - 2), 5, None]
    out = packing.pack(spark, docs_of(texts, ids=ids), registry.PACK_VOCABULARY, P.PATTERN).collect()
    own = packing.Encoder(registry.PACK_VOCABULARY, P.PATTERN)
    want = sorted((i if i is not None else -1, s, n, zlib.crc32(np.append(own.ids(t or ""), np.uint32(2)).astype("<u4")[s : s + n].tobytes())) for i, t in zip(ids, texts) for s, n in packing.cut(len(own.ids(t or "")) + 1, 1024))
    assert sorted((o.doc_id if o.doc_id is not None else -1, o.start, o.length, o.ids_crc32) for o in out) == want
    used = defaultdict(list)
    for o in out:
        used[o.sequence_id].append((o.offset, o.length))
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(spark, docs_of([]), registry.PACK_VOCABULARY, P.PATTERN).count() == 0
