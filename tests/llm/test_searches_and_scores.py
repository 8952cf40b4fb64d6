import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import expected, found
from quernstone.llm import ann, ngrams, registry, topk
from quernstone.llm.common import LOWER, SPACE

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert found(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) == expected(registry.ORACLE_SQL[name], "/root/testdata/sf0.001")


def vectors(seed, n, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    ids = r.permutation(n * 2)[:n]
    ids[0] = ids[0] // 50 * 50 if ids[0] // 50 * 50 not in ids[1:] else ids[0]
    return ids.astype(int), x


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x)], SCHEMA)


def test_recall_and_exact_scores(spark):
    ids, x = vectors(1, 9000)
    got = {}
    for r in ann.search(spark, frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((ids, -score))[:5]
        rows = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
        of = dict(zip(ids, score))
        assert all(abs(of[r.vec_id] - r.score) < 1e-12 for r in rows)
        hits += len({r.vec_id for r in rows} & {*ids[best]})
        total += 5
    assert hits / total >= 0.9


def test_top_k_equals_brute_force(spark):
    ids, x = vectors(2, 9000)
    rows = topk.search(spark, frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect()
    w = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = w @ w[q]
        score[q] = np.iinfo(np.int64).min + 1
        want |= {(int(ids[q]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(np.lexsort((ids, -score))[:5])}
    assert {tuple(r) for r in rows} == want


def test_driver_gets_little_however_many_tasks(spark, tmp_path):
    """24 tasks with 1.1 MB of possible seed rows each, and copies of the queries that could be broadcast."""
    hashed = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(2001)) / 1000 - 1).cast("float"))
    spark.range(0, 60_000, 1, 24).select(F.col("id").alias("vec_id"), hashed.alias("embedding")).write.parquet(f"{tmp_path}/rows")
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "12m")
    try:
        rows = spark.read.parquet(f"{tmp_path}/rows").repartition(24)
        out = topk.search(spark, rows, F.col("vec_id") % 1000 == 0)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.collect()}
    finally:
        conf.set("spark.driver.maxResultSize", before)
    held = rows.orderBy("vec_id").collect()
    w = topk.weights(np.array([r.embedding for r in held], np.float64))
    want = set()
    for q in range(0, len(w), 1000):
        score = w @ w[q]
        score[q] = np.iinfo(np.int64).min + 1
        want |= {(q, k + 1, int(j), int(score[j])) for k, j in enumerate(np.lexsort((np.arange(len(w)), -score))[:5])}
    assert got == want


def test_pruning_skips_blocks_of_a_table(spark):
    """Rows of 40 clusters, dealt at random: like rows meet in a block, so that bounds exclude most blocks."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 8)) * 4
    x = (centres[r.integers(0, 40, 12_000)] + r.normal(size=(12_000, 8)) * 0.05).astype(np.float32)
    ids = r.permutation(len(x)).astype(int)
    scored = []
    w = topk.weights(x.astype(np.float64))
    tree = topk.Tree(w[:2048], 3)
    leaf = tree.leaf(w)
    queries = np.flatnonzero(ids % 50 == 0)
    for k in range(tree.leaves):
        some = np.flatnonzero(leaf == k)
        *_, n = topk.search_range(ids[queries], w[queries], topk.floors(ids[queries], w[queries], ids[:2048], w[:2048], 5), ids[some], w[some], 5)
        scored.append((n, len(queries) * -(-len(some) // topk.BLOCK)))
    assert sum(n for n, _ in scored) < 0.2 * sum(n for _, n in scored)
    rows = topk.search(spark, frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect()
    score = w[queries] @ w.T
    want = set()
    for j, q in enumerate(queries):
        score[j, q] = np.iinfo(np.int64).min + 1
        want |= {(int(ids[q]), k + 1, int(ids[i]), int(score[j, i])) for k, i in enumerate(np.lexsort((ids, -score[j]))[:5])}
    assert {tuple(row) for row in rows} == want


def test_recall_with_many_lists(spark):
    r = np.random.default_rng(9)
    ids, x = np.arange(6000), r.normal(size=(6000, 32)).astype(np.float32)  # no structure: the hardest case
    index = ann.Index(ann.unit(x.astype(np.float64))[:4000], len(x))
    assert len(index.centres) == 77
    got = {}
    for row in ann.search(spark, frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    unit = ann.unit(x.astype(np.float64))
    hits = 0
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(got[q] & {*np.argsort(-score)[:5].tolist()})
    assert 0.9 * 600 <= hits


def test_pruning_skips_blocks():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-10, 10, (topk.BLOCK * 31, 8)), r.integers(90, 100, (topk.BLOCK, 8))]).astype(np.int64)
    ids = np.arange(len(x))
    *out, scored = topk.search_range(ids[-2:], x[-2:], np.full(2, np.iinfo(np.int64).min), ids, x, 5)
    assert scored == 2 and len(out[0]) == 10


def test_large_weights_stay_exact():
    q = np.array([[2**40, -(2**40) + 1]], np.int64)
    assert topk.product(q, np.array([[3, 5], [2**20, 1]], np.int64)).tolist() == [[3 * 2**40 - 5 * (2**40 - 1), 2**60 - 2**40 + 1]]


@pytest.mark.parametrize("search", [ann.search, topk.search])
def test_odd_vectors(spark, search):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"vector": F.lit("mine"), "list": F.lit(1), "row": F.lit(None)})
    got = search(spark, df, F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    zero = [2] if search is topk.search else []
    assert by == {0: [50, 50, 1, *zero], 50: [0, 1, *zero]}
    assert search(spark, df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# -- stupid backoff --------------------------------------------------------------


def brute(texts):
    low = bytes(LOWER)
    docs = [bytes(b if not SPACE[b] else 32 for b in (t or "").encode().translate(low)).split(b" ") for t in texts]
    docs = [[w for w in d if w] for d in docs]
    words, pairs, before = (Counter(), Counter(), Counter())
    own = []
    for d in docs:
        w, p = Counter(d), Counter(zip([None, *d], d))
        b = w + Counter({None: 1} if d else {})
        own.append((w, p, b))
        words, pairs, before = words + w, pairs + p, before + b
    n = sum(words.values())
    out = []
    for d, (w, p, b) in zip(docs, own):
        kinds, s = [0, 0, 0], 0.0
        for v, x in zip([None, *d], d):
            c2, c1 = pairs[v, x] - p[v, x], words[x] - w[x]
            if c2:
                kinds[0] += 1
                s += math.log(c2 / (before[v] - b[v]))
            elif c1:
                kinds[1] += 1
                s += math.log(0.4 * c1 / (n - len(d)))
            else:
                kinds[2] += 1
                s += math.log(0.4 * 0.5 / (n - len(d) + 1))
        out.append((len(d), *kinds, s))
    return out


@pytest.mark.parametrize("chunk, part", [(ngrams.CHUNK, ngrams.SLICE), (300, 500)])
def test_scores_equal_brute_force(spark, docs_of, chunk, part):
    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "B", "c", "dd", "é", "word%d" % r.randrange(200)]) for _ in range(r.choice([0, 1, 2, 30, 300]))) for _ in range(60)]
    texts += ["the same text here"] * 8 + [None, "", " \n\t", "only once", "x" * 30_000]
    ids = [*range(len(texts) - 1), None]
    got = ngrams.score(spark, docs_of(texts, ids=ids), 2, chunk, part).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t[:5])
    got, want = sorted(map(tuple, got), key=key), sorted(((i, *row) for i, row in zip(ids, brute(texts))), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_trigrams_back_off_twice(spark, docs_of):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "e%d" % r.randrange(40)]) for _ in range(r.choice([0, 1, 2, 3, 80]))) for _ in range(40)] + [None, "a a a a"]
    docs = [[None, *t.split()] if t else [] for t in texts]
    grams = [Counter(tuple(d[i - m + 1 : i + 1]) for m in (1, 2, 3) for i in range(m - 1, len(d))) for d in docs]
    total, n = sum(grams, Counter()), sum(max(0, len(d) - 1) for d in docs)
    want = []
    for i, d in enumerate(docs):
        kinds, s = [0, 0, 0, 0], 0.0
        left = lambda g: total[g] - grams[i][g]
        for j in range(1, len(d)):
            factor = 1.0
            for m in (3, 2, 1):
                if j - m + 1 < 0:
                    continue
                g = tuple(d[j - m + 1 : j + 1])
                if left(g):
                    s += math.log(factor * left(g) / (left(g[:-1]) if m > 1 else n - len(d) + 1))
                    kinds[3 - m] += 1
                    break
                if m > 1:
                    factor *= 0.4
            else:
                s += math.log(factor * 0.5 / (n - len(d) + 2))
                kinds[3] += 1
        want.append((i, max(0, len(d) - 1), *kinds, s))
    got = sorted(map(tuple, ngrams.score(spark, docs_of(texts), 3, 200, 300).collect()))
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want])


def test_scores_of_no_documents(spark, docs_of):
    assert ngrams.score(spark, docs_of([])).count() == 0
