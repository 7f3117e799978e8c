"""Field search by an index finds what a scan finds, and reads its own groups alone."""

import pytest

from filegrain.operators import relational as R
from filegrain.operators import search

ROWS = [(1, "Author", "Ivan İnce", "Info"), (2, "Title", "in the ınn", None), (3, None, "x", "XMP — INFO"), (4, "k", "", ""), (5, "ab", "cd", "ef"), (5, "Author", "again", "s"), (6, "😀😀😀", "abcabcabc", "é")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "n long, k string, v string, section_title string")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    search.write_index(rows, "n", path, 16)
    return path


@pytest.mark.parametrize("query", ["author", "INN", "i", "", "info", "ın", "bcabca", "bcd", "nothing at all", "😀😀😀", "XMP — I"])
def test_same_rows_as_a_scan(rows, index, query):
    got = sorted(map(tuple, search.indexed_search(rows, "n", index, query, 16).collect()), key=str)
    assert got == sorted(map(tuple, R.field_search(rows, query).collect()), key=str)


def test_groups_of_the_query_alone_are_read(spark, index):
    found = search.candidates(spark, index, "author", 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:200]
    assert "Python" not in plan and sorted(r["row"] for r in found.collect()) == [1, 5]


def test_an_empty_table(spark, rows, tmp_path):
    search.write_index(rows.limit(0), "n", f"{tmp_path}/i")
    assert search.indexed_search(rows.limit(0), "n", f"{tmp_path}/i", "author").count() == 0
