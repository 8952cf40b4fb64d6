import itertools
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quernstone.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"] and cp.ORACLE_SQL is None
    numbers = [int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11))


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def survivors(texts):
    """Ids that stay, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def without_repeats(texts):
    """Texts without the bytes of 400-byte strings that start twice, by counting all of them."""
    raws = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(r[k : k + 400]) for r in raws.values() for k in range(len(r) - 399))
    out = {}
    for i, r in raws.items():
        gone = bytearray(len(r))
        for k in range(len(r) - 399):
            if seen[hash(r[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        out[i] = bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    one = cp.language_id(spark, docs, SF)
    kept = {r.doc_id for r in one.collect()}
    # by the words of its language that a text has; the declarations are right in these tables
    assert one.columns == COLUMNS and len(kept) > 0.95 * len(rows)
    assert all(sum(c.isalpha() for c in (rows[i].text or "")) < 0.5 * max(1, len(rows[i].text or "")) or len((rows[i].text or "").split()) < 20 or (rows[i].text or "").isupper() for i in {*rows} - kept)

    two = cp.quality_filter(spark, one, SF).cache()
    good = {r.doc_id for r in two.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in kept & {*labels} if zlib.crc32(str(i).encode()) % 3 == 1]
    assert two.columns == COLUMNS and good <= kept
    assert sum((i in good) == (labels[i].quality == 1) for i in held) >= 0.95 * len(held)

    three = cp.near_dedup(spark, two, SF).cache()
    left = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == COLUMNS and {*left} == survivors({i: rows[i].text for i in good}) and all(left[i] == rows[i].text for i in left)

    four = cp.suffix_dedup(spark, three, SF).cache()
    cut = {r.doc_id: r for r in four.collect()}
    assert four.columns == COLUMNS and {i: r.text for i, r in cut.items()} == without_repeats(left)
    assert all(r.n_chars == len(r.text) for r in cut.values())

    five = cp.pack(spark, four, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins, filled = {}, 0
    for i, r in cut.items():
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        own = sorted((p for p in five if p.doc_id == i), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own))) and sum(p.length for p in own) == len(ids)
        filled += len(ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length])) and (p.length == 1024 or p.piece == 0)
            bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for slots in bins.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and slots[-1][0] + slots[-1][1] <= 1024
    assert len(five) == sum(map(len, bins.values())) and len(bins) <= -(-filled // 1024) * 1.05 + 1

    whole = cp.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five)


def test_near_dedup_keeps_one_of_each_group(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_1 string"
    text, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(62))
    lone = "a text that nothing else is like at all"
    rows = [(None, text), (None, near), (None, text), (None, lone), (5, lone.upper() + " x y z"), (7, None), (None, ""), (None, ""), (9, "one two"), (9, "ONE two"), (9, "other words")]
    docs = spark.createDataFrame([(i, t, None, None, 1, "mine") for i, t in rows], schema)
    out = cp.near_dedup(spark, docs, SF)
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in out.collect())
    assert out.columns == docs.columns and [g for g in got if g[1] not in (text, near)] == sorted([("5", lone + " x y z"), ("7", ""), ("None", ""), ("None", lone), ("9", "one two"), ("9", "other words")])
    assert sum(g[1] in (text, near) for g in got) == 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the cat sat on the mat " * 50, "en", None, 1)]])
def test_odd_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ({2} if rows else set())
