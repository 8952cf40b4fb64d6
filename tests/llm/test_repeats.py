import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import repeats


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(r, mark) if not m)
        out.append((len(r), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def prose(r, n):
    return "".join(r.choice("abcdefgh é\n") for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (380, 399, 400, 401, 450, 900, 3000)]
    texts = []
    for _ in range(25):
        parts = [prose(r, r.choice([0, 1, 30, 500])) for _ in range(3)]
        texts.append(parts[0] + r.choice(shared) + parts[1] + r.choice(shared + [""]) + parts[2])
    return texts + ["a" * 900, "ab" * 600, ("the same line again\n" * 80), "x" * 399, "", None, texts[0], prose(r, 50_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs_of, seed):
    texts = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in repeats.digests(spark, docs_of(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab", max_size=700), max_size=6))
def test_any_texts(spark, docs_of, texts):
    got = {r[0]: tuple(r)[1:] for r in repeats.digests(spark, docs_of(texts), 150).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 150)


def test_cells_hold_every_window_once():
    raws = [(t or "").encode() for t in corpus(3)]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    doc, start, n, _, _ = repeats.cells(data, offsets)
    held = Counter((d, s + k) for d, s, c in zip(doc, start, n) for k in range(c))
    assert held == Counter((d, s) for d, r in enumerate(raws) for s in range(len(r) - 399))


def test_rows_alike_and_null_ids(spark, docs_of):
    text = prose(random.Random(5), 1000)
    n = len(text.encode())
    got = repeats.digests(spark, docs_of([text, text, text, "other"], ids=[7, 7, None, None])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, n), (False, n), (True, 0), (True, n)]


def test_remove_keeps_columns_and_characters(spark, docs_of):
    shared = "é" * 50 + prose(random.Random(6), 500)
    docs = docs_of(["é" + shared + "1", "x" + shared + "2"]).withColumn("repeated_spans", F.lit("mine"))
    out = repeats.remove(spark, docs).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["é1", "x2"] and out[0].repeated_spans == "mine"


def test_empty_table(spark, docs_of):
    assert repeats.digests(spark, docs_of([])).count() == 0
