import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import language, pages, quality

SF = "/root/testdata/sf0.01"


# -- quality -------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    assert len(rows) > 80 and right > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert one == two


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    data = np.frombuffer(b"some words here and some more", np.uint8)
    index, counts, stats = quality.features(data, np.array([0, 10, len(data)]))
    model = quality.Machine(0.1, r.normal(size=quality.SIZE), r.normal(size=(quality.SIZE, 3)), np.sort(r.normal(size=(len(quality.STATISTICS), quality.BINS - 1))), stats.mean(axis=0), stats.std(axis=0) + 1)
    feature, x, start = model.rows(index, counts, stats)
    raw, _ = model.parts(feature, x, start)
    for k in range(2):
        f, v = feature[start[k] : start[k + 1]], x[start[k] : start[k + 1]]
        pairs = sum(model.factors[f[i]] @ model.factors[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert np.isclose(raw[k], 0.1 + model.weights[f] @ v + pairs)


def plain_features(text, declared):
    """(hashed words, statistics) of a text by a walk over its bytes."""
    raw = (text or "").encode()
    spaces = bytes([32, *range(9, 14)])
    words, word = [], b""
    for b in raw + b" ":
        if b in spaces:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    rolling, mask = quality.Rolling(71), (1 << 64) - 1

    def hashed(w):
        x = sum(int(rolling.values[b]) * pow(rolling.base, k, 1 << 64) for k, b in enumerate(w)) + len(w) * 0xD6E8FEB86659FD93 & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return x ^ x >> 31

    n = max(1, len(raw))
    share = lambda test: sum(map(test, raw)) / n
    digit, capital, space, high = (lambda b: 48 <= b <= 57), (lambda b: 65 <= b <= 90), (lambda b: b in spaces), (lambda b: b >= 128)
    letter = lambda b: capital(b) or 97 <= b <= 122 or high(b)
    lines = raw.split(b"\n")
    stats = [math.log1p(len(words)), math.log1p(len(raw)), share(lambda b: not (letter(b) or digit(b) or space(b))), share(digit), share(capital), share(space), share(high),
             sum(map(len, words)) / max(1, len(words)), len({*words}) / max(1, len(words)), len({*lines}) / len(lines), math.log1p(len(words) / len(lines)),
             sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), share(lambda b: b == 124), 0.0 if declared is None else math.log1p(max(0, declared)), float(declared is None)]
    return sorted({hashed(w) % quality.WORDS for w in words}), stats


def plain_score(model, text, declared):
    """All pairs of features, one by one."""
    words, stats = plain_features(text, declared)
    x = {w: 1 / math.sqrt(len(words)) for w in words}
    for j, value in enumerate(stats):
        base = quality.WORDS + j * (quality.BINS + 2)
        x[base] = min(3.0, max(-3.0, (value - model.centre[j]) / model.scale[j])) / 3 * 0.5
        x[base + 1 + sum(edge <= value for edge in model.edges[j])] = 0.5
    raw = model.bias + sum(model.weights[i] * v for i, v in x.items())
    raw += sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, raw))))


def test_scores_equal_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert np.abs(model.factors).max() > 0.05 and np.abs(model.weights).max() > 0.05
    some = [r for r in docs.orderBy("doc_id").collect() if len(r.text) < 1500][:25]
    rows = [(r.doc_id, r.text, r.n_chars) for r in some] + [(-1, None, None), (-2, "", 5), (-3, "12 | 12 | É\n\n12", -4), (-4, "a\x0bb c", None)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), model).collect()
    assert np.allclose([r.score for r in got], [plain_score(model, t, n) for _, t, n in rows], rtol=1e-9, atol=1e-12)


def test_odd_rows(spark, docs_of):
    docs = docs_of(["", None, "word " * 20_000, "a b", "a b"], ids=[0, None, 2, 3, 3])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    odd = spark.createDataFrame([(2, 1, 0), (None, 0, 0), (3, None, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, odd).count() == 5
    assert quality.classify(docs_of([]), odd).count() == 0


# -- language ------------------------------------------------------------------


def test_languages_and_wrong_declarations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 25 == 0, "fr").otherwise(F.col("lang"))).withColumn("language", F.lit("mine"))
    rows = language.identify_documents(spark, wrong).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert np.mean([r._language == r.true for r in rows]) > 0.98
    assert all(r.language == "mine" for r in rows) and np.mean([r.accepted for r in rows]) > 0.98


def test_every_declared_language_is_learned(spark, docs_of):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts, langs = [], []
    for k in range(230):
        words = ["".join(r.choices(letters, k=r.randint(4, 8))) for _ in range(25)]
        code = "l" + letters[k // 26] + letters[k % 26]
        said = (code, f"{code.upper()}-XX", f" {code}_yy", None) if k < 200 else (f"{code}-Latn", code, None)
        for x in said:
            texts.append(" ".join(r.choices(words, k=60)))
            langs.append((x, code))
    ids = list(range(len(texts)))
    docs = docs_of(texts).drop("lang").join(spark.createDataFrame([(i, *x) for i, x in zip(ids, langs)], "doc_id long, lang string, true string"), "doc_id")
    rows = language.identify_documents(spark, docs).collect()
    assert len(rows) == len(texts) and all(x.language == x.true and x.accepted for x in rows)


def fused(rows, evidence=60.0, slots=1 << 14, pull=20.0):
    """(language, confidence) of (text, declaration, suffix, host), in plain Python."""

    def slots_of(text):
        raw = (text or "").encode()
        low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
        found = set()
        for a, b, c in zip(low, low[1:], low[2:]):
            if (a, b) != (32, 32) and (b, c) != (32, 32):
                found.add((((a << 16 | b << 8 | c) * 2654435761) >> 16) % slots)
        return found, any(b != 32 for b in low)

    seen = [slots_of(r[0]) for r in rows]
    classes = [*sorted({r[1] for r in rows if r[1]}), "und"]
    models = {}
    for name in classes[:-1]:
        n = Counter(s for (found, _), r in zip(seen, rows) if r[1] == name for s in found)
        whole = sum(n.values())
        models[name] = lambda s, n=n, whole=whole: math.log((n[s] + 0.1) / (whole + 0.1 * slots))
    models["und"] = lambda s: -math.log(slots)
    texts = [[min(1.0, evidence / max(1, len(found))) * sum(models[c](s) for s in sorted(found)) for c in classes] if letters else None for found, letters in seen]
    first = [None if x is None else x.index(max(x)) for x in texts]
    overall = [1 + first.count(k) for k in range(len(classes))]
    share = [x / sum(overall) for x in overall]
    share[-1] = min(share[-1], 1e-3)
    parent = lambda h: h.split(".", 1)[1] if h.count(".") > 1 else h

    def counts(of):
        out = {}
        for r, k in zip(rows, first):
            if k is not None and of(r) is not None:
                out.setdefault(of(r), Counter())[k] += 1
        return out

    said, suffix, hosts = (counts(lambda r, j=j: r[j]) for j in (1, 2, 3))
    parents = counts(lambda r: None if r[3] is None else parent(r[3]))
    drawn = lambda n, above: [(n[k] + pull * above[k]) / (sum(n.values()) + pull) for k in range(len(classes))]
    out = []
    for r, text in zip(rows, texts):
        total = list(text or [0.0] * len(classes))
        for table, value in ((said, r[1]), (suffix, r[2])):
            if value in table:
                total = [t + math.log((table[value][k] + 0.5) / (overall[k] + 1.0)) for k, t in enumerate(total)]
        prior = drawn(hosts[r[3]], drawn(parents[parent(r[3])], share)) if r[3] in hosts else share
        total = [t + math.log(p) for t, p in zip(total, prior)]
        top = max(total)
        out.append(("und" if text is None else classes[total.index(top)], 1 / sum(math.exp(t - top) for t in total)))
    return out


def test_fusion_equals_plain_python(spark):
    r = random.Random(8)
    words = {"aa": "gato perro casa rojo luna", "bb": "hund katze haus mond rot", "cc": "chien maison lune rouge"}
    rows = []
    for k in range(120):
        true = r.choice(list(words))
        text = " ".join(r.choices(words[true].split(), k=r.choice([0, 1, 3, 40])))
        said = r.choice([true, true, true, "aa", None])
        host = r.choice([None, "www.one.example", "blog.one.example", "two.example", f"{true}.three.example"])
        rows.append((text, said, r.choice([None, true, "com"]), host))
    rows += [(None, "aa", None, None), ("12 !!", None, "com", "two.example"), ("Zzyx qqq", None, None, None), ("gato " * 30_000, None, None, "new.host.example"), rows[0], rows[0]]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k long, text string, said string, suffix string, host string")
    clashing = df.withColumns({"_lid_total": F.lit("mine"), "language": F.lit("mine")})
    got = sorted(language.identify(spark, clashing, "text", F.col("said"), F.col("host"), F.col("suffix")).collect(), key=lambda x: x.k)
    want = fused(rows)
    assert [x._language for x in got] == [w[0] for w in want] and all(x._lid_total == x.language == "mine" for x in got)
    assert np.allclose([x.confidence for x in got], [w[1] for w in want])


@pytest.mark.parametrize("said, primary", [("en", "en"), ("EN-us", "en"), (" pt_BR", "pt"), ("", None), ("und", None), (None, None), ("-x", None)])
def test_declarations(spark, said, primary):
    assert spark.range(1).select(language.declaration(F.lit(said).cast("string"))).first()[0] == primary


def test_pages(spark):
    rows = language.identify_pages(spark, spark.read.parquet(f"{SF}/pages.parquet")).select("html", "language").collect()
    assert np.mean([f'lang="{r.language}"' in r.html for r in rows]) > 0.95


def test_odd_pages(spark):
    page = '<html lang="EN-us"><body>' + "the cat and the dog " * 30 + "</body></html>"
    rows = [(1, "http://a.example/x", page), (2, None, page), (3, "http://a.example/", None), (None, None, None), (4, "nonsense", ""), (1, "http://a.example/x", page)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, visible string")
    got = sorted(language.identify_pages(spark, df).collect(), key=lambda r: (r.page_id or 0, r.language))
    assert [(r.page_id, r.language, r.accepted, r.visible) for r in got] == [(None, "und", False, "mine"), (1, "en", True, "mine"), (1, "en", True, "mine"), (2, "en", True, "mine"), (3, "und", False, "mine"), (4, "und", False, "mine")]
    assert language.identify_pages(spark, df.where("false")).count() == 0


def test_language_of_odd_rows(spark, docs_of):
    docs = docs_of(["the cat and the dog " * 30, "", None, "123 !!", "the dog", "the dog"], ids=[0, 1, None, 3, 4, 4])
    rows = language.identify_documents(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.language, r.accepted) for r in rows) == [(0, "en", True), (0, "und", False), (1, "und", False), (3, "und", False), (4, "en", True), (4, "en", True)]
    undeclared = language.identify(spark, docs).collect()
    assert {(r.language, r.accepted) for r in undeclared} == {("und", False)}
    assert language.identify_documents(spark, docs_of([])).count() == 0


@pytest.mark.parametrize("url, host, parent, suffix", [("http://a.b.example.com:80/x?y", "a.b.example.com", "b.example.com", "com"), ("https://u@Example.ORG", "example.org", "example.org", "org"), ("nonsense", "", "", None)])
def test_hosts(spark, url, host, parent, suffix):
    h = language.host_of(F.lit(url))
    assert tuple(spark.range(1).select(h, language.parent_of(h), language.suffix_of(h)).first()) == (host, parent, suffix)


# -- pages ---------------------------------------------------------------------


def test_blocks():
    page = '<html><head><title>t</title><style>p{}</style></head><body><ul><li>a<li>b &amp; c</ul><script>var x="</p>"</script><p>one <b>two<br>three<p>four<!-- no -->five<table><tr><td>x<td>y</table><a title="a>b">z'
    found = pages.blocks(page)
    assert [b.text for b in found] == ["a", "b & c", "one two three", "fourfive", "x", "y", "z"]
    assert found[0].path[-1] == "li" and "li" in found[1].path and found[1].path.count("li") == 1
    assert pages.blocks("") == [] and [b.text for b in pages.blocks("1 < 2 <p")] == ["1 < 2"]


def test_gradient_is_the_slope():
    r = np.random.default_rng(5)
    x, mask = r.normal(size=(4, 3, pages.WIDTH)).astype(np.float32), np.ones((4, 3), bool)
    mask[3, 1] = mask[2:, 2] = False
    y = (r.random((4, 3)) > 0.5).astype(np.float32)
    model = pages.Labeller.start(3)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    loss, g = model.gradient(x, mask, y)
    for name in ("fx", "fh", "fo", "bx", "bh", "out", "own", "bias"):
        part = model.parts[name]
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), part.shape)
        part[at] += 1e-4
        high = model.gradient(x, mask, y)[0]
        part[at] -= 2e-4
        low = model.gradient(x, mask, y)[0]
        part[at] += 1e-4
        assert np.isclose((high - low) / 2e-4, g[name][at], rtol=0.05, atol=1e-5), name


def test_unseen_pages():
    r, model = random.Random(1234), pages.trained()
    right = total = 0
    for _ in range(150):
        page, main = pages.sample_page(r)
        found = pages.blocks(page)
        labels = model.labels([pages.vectors(found)])[0]
        right += sum(bool(a) == (b.text in main) for a, b in zip(labels, found))
        total += len(found)
    assert right / total > 0.985


def test_whole_blocks_and_paths_count():
    opening = "One more word of an opening that two blocks share. " * 5
    x = pages.vectors([pages.Block(opening + "alpha beta gamma delta", ("p",)), pages.Block(opening + "kappa sigma theta omega", ("p",))])
    words = slice(pages.PATHS, pages.PATHS + pages.WORDS)
    assert len(x) == 2 and not np.array_equal(x[0, words], x[1, words]) and np.allclose(x[:, words].sum(axis=1), 1)
    for k in (10, 60, 3000):
        inner = ("div", ".row", ".col") * k
        assert not np.array_equal(*pages.vectors([pages.Block("a", ("nav", ".menu", *inner)), pages.Block("a", ("article", ".story", *inner))])[:, : pages.PATHS])


def test_extract(spark):
    filled = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>" + "Some words. " * 40 + "</p></article><footer>&copy; 2020 x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", filled), (2, "u", ""), (3, None, None), (4, "u", "<p" * 10), (4, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    rows = {r.page_id: r for r in pages.extract(df).collect()}
    assert rows[1]._text == "Title here\n" + " ".join(["Some words."] * 40) and rows[1].text == "mine"
    assert rows[2]._text == rows[3]._text == ""
    assert pages.extract(df.where("false")).count() == 0


def test_articles_of_the_given_pages(spark):
    import html
    import re

    rows = pages.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
