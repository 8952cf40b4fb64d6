import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import common


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder():
    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]")).startswith("file://") and common.shared_dir(session("local")) == common.shared_dir(session("local[2]"))
    for master in ("yarn", "spark://x:7077", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


@pytest.mark.parametrize("slim", [False, True])
def test_staged_tables(spark, slim):
    staged = common.Staging(spark, "staged")
    kept = {k: spark.conf.get(k, None) for k in (common.CLEANUP, common.BATCH_BYTES)}
    out = staged.put("a", spark.range(10).repartition(3, "id"), slim)
    assert sorted(r.id for r in out.collect()) == list(range(10)) == sorted(r.id for r in out.collect())
    assert {k: spark.conf.get(k, None) for k in kept} == kept
    folder = staged.root.removeprefix("file://")
    assert os.listdir(folder) == ["a"]
    staged.drop("a", "never there")
    assert os.listdir(folder) == []
    with pytest.raises(Exception):
        staged.put("b", spark.range(3).selectExpr("assert_true(id > 5) AS x"))
    assert {k: spark.conf.get(k, None) for k in kept} == kept


def test_chunks_hold_whole_texts():
    offsets = np.array([0, 3, 3, 20, 21, 22])
    assert list(common.chunks(offsets, 4)) == [(0, 2), (2, 3), (3, 5)] and list(common.chunks(np.array([0]), 4)) == []


def test_ranges_hash_alike_wherever_they_stand():
    r = np.random.default_rng(2)
    rolling, data = common.Rolling(5), r.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3100] = data[100:200]
    prefix = rolling.prefix(data)
    at = np.array([100, 3000, 101])
    one, two, three = rolling.ranges(prefix, at, at + 100)
    assert one == two != three and rolling.ranges(prefix, at[:1], at[:1] + 99)[0] != one


def test_text_buffers():
    column = pa.array(["é", None, "", "abc"]).slice(0, 4)
    data, offsets = common.text_buffer(column)
    assert bytes(data) == "éabc".encode() and offsets.tolist() == [0, 2, 2, 2, 5]
    data, offsets = common.text_buffer(column.slice(2))
    assert bytes(data) == b"abc" and offsets.tolist() == [0, 0, 3]
