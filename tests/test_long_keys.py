"""Queries against their SQL on tables whose keys are longer than the given ones."""

import os

import duckdb
import pytest
from oracle import TABLES, expected, found

from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"


def tables(folder, **changed):
    """The tables of SF, those of `changed` as its SQL makes them from `t`."""
    for name in TABLES:
        if name in changed:
            duckdb.execute(f"copy (select {changed[name]} from '{SF}/{name}.parquet' t) to '{folder}/{name}.parquet' (format parquet)")
        else:
            os.symlink(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    return tables(
        tmp_path_factory.mktemp("long"), documents="t.* replace (doc_id * 9000 as doc_id)", labels="t.* replace (doc_id * 9000 as doc_id)", events="t.* replace (event_id * 7919 as event_id)"
    )


def same(spark, name, folder):
    got, want = found(catalogue.QUERIES[name](spark, folder)), expected(catalogue.ORACLE_SQL[name], folder)
    assert got == want and len(want[1])


@pytest.mark.parametrize("name", ["caption_selection", "overwrite_targets"])
def test_long_document_ids(spark, long_keys, name):
    same(spark, name, long_keys)


def test_manifest_of_long_indices(spark, long_keys):
    same(spark, "manifest_file", long_keys)


def test_selection_with_unknown_names(spark, tmp_path):
    """Some names of labels are unknown, others are known by their first six digits alone."""
    folder = tables(tmp_path, documents="t.* replace (doc_id * 9000 as doc_id)", labels="t.* replace (case when doc_id % 2 = 0 then doc_id * 9000 else doc_id * 9000 + 5000001 end as doc_id)")
    same(spark, "unknown_selection", folder)
