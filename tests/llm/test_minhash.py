import itertools
import random

import numpy as np
import pytest

from quernstone.llm import components as cc
from quernstone.llm import minhash
from quernstone.llm.common import LOWER, Staging


def brute(texts, ids):
    import re

    words = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = words.findall((t or "").encode().translate(bytes(LOWER)))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [(len(s), ids[find(k)]) for k, s in enumerate(sets)]


def corpus(seed, copies):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 60, 200]))) for _ in range(40)]
    base = " ".join(r.choice(vocabulary) for _ in range(150)).split()
    for _ in range(copies):  # a star: copies are near to the base, often not to each other
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    for k in range(12):  # pairs around the threshold
        words = texts[k + 3].split()
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [texts[5]] * 20 + [texts[5].upper().replace(" ", "\n\t")] + ["", None, "  \n", "one", "ONE", "é É", "É é"]
    return texts


@pytest.mark.parametrize("seed, copies", [(1, 30), (2, 120)])
def test_equals_brute_force(spark, docs_of, seed, copies):
    texts = corpus(seed, copies)
    ids = random.Random(seed).sample(range(-50, 5000), len(texts))
    want = brute(texts, ids)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, docs_of(texts, ids=ids)).collect()}
    for i, (size, component) in zip(ids, want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (size, component, i == component)


def test_second_round_finds_all_that_the_first_misses(spark, docs_of, monkeypatch):
    texts = corpus(3, 60)
    texts.append(" ".join(f"w{k % 7000}" for k in range(60_000)))  # a very long text and its near copy
    texts.append(texts[-1] + " one more word")
    monkeypatch.setattr(minhash, "partners", lambda classes, threshold: spark.createDataFrame([], "a binary, b binary"))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, docs_of(texts).withColumnsRenamed({"lang": "node", "source": "label"})).collect()}
    want = brute(texts, list(range(len(texts))))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want


def test_open_pairs_of_a_large_group_do_not_grow_with_its_square(spark, docs_of, monkeypatch):
    """Copies of one text with two other words: those with one place in common are at 0.748, those with both linked."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(108)]
    places = list(itertools.combinations(range(5, 101, 5), 2))
    texts = []
    for pair in places + places[:20]:
        words = list(base)
        for k in pair:
            words[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    counted, across = [], minhash.across

    def counting(dealt, threshold):
        out = across(dealt, threshold)
        counted.append(out.count())
        return out

    monkeypatch.setattr(minhash, "across", counting)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, docs_of(texts)).collect()}
    want = brute(texts, list(range(len(texts))))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert len({component for _, component in want}) == len(places)
    assert counted[0] < 5 * len(texts)


def test_repeated_and_null_ids(spark, docs_of):
    text = "a b c d e f g"
    got = minhash.near_duplicates(spark, docs_of([text, text, text, "other words", "x y", "x y"], ids=[3, 3, None, 3, None, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 1, -1, False), (-1, 1, -1, False), (-1, 3, 3, False), (3, 1, 3, True), (3, 3, 3, True), (3, 3, 3, True)]


def test_empty_and_lonely(spark, docs_of):
    assert minhash.near_duplicates(spark, docs_of([])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(spark, docs_of([None])).collect()] == [(0, 0, 0, True)]


def test_odd_sketches_estimate_similarity():
    r = np.random.default_rng(4)
    for share in (0.6, 0.75, 0.9):
        n = 2000
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        both = int(n * 2 * share / (1 + share))
        b = np.concatenate([a[:both], r.integers(0, 1 << 63, n - both).astype(np.uint64)])
        a, b = np.sort(a), np.sort(b)
        sizes = np.array([n, n])
        _, _, odd = minhash.signatures(np.concatenate([a, b]), sizes)
        true = both / (2 * n - both)
        assert abs(minhash.similarity(minhash.distances(odd[0], odd[1])) - true) < minhash.MARGIN
        whole = [np.frombuffer(x, np.uint8) for x in minhash.whole_sketches(np.concatenate([a, b]), sizes)]
        over = minhash.excess(minhash.distances(*whole), len(whole[0]), np.float64(2 * n), true)
        assert over <= 0 < minhash.excess(minhash.distances(*whole), len(whole[0]), np.float64(2 * n), min(0.99, true + 0.08))
        assert (minhash.folded(whole[0], 64) ^ minhash.folded(whole[1], 64) == minhash.folded(whole[0] ^ whole[1], 64)).all()


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in cc.components(Staging(spark, "test"), df).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
