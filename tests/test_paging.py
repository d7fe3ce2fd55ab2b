"""Pages against slices of the sorted rows."""

import random
import re

import pytest

from folioscope.operators.paging import Listing

SCHEMA = "k string, n int, _v string"


@pytest.fixture(scope="module")
def listing(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", None, ""]), n, f"v{n}") for n in range(500)]
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    rng.shuffle(rows)
    return Listing(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k", "n"], parts=7), wanted


@pytest.mark.parametrize("skip,limit", [(0, 10), (0, 0), (64, 9), (130, 200), (495, 20), (500, 5), (10**9, 5), (0, 1000)])
def test_pages_are_slices(listing, skip, limit):
    pages, wanted = listing
    assert [tuple(r) for r in pages.page(skip, limit).collect()] == wanted[skip : skip + limit]


def test_a_deep_page_reads_its_folders_only(listing):
    pages, wanted = listing
    assert len(pages) == len(wanted) and len(pages.directory) > 3
    part, start, end = pages.directory[-1]
    deep = pages.page(len(wanted) - 5, 5)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[.*\(_part#\d+ = {part}\)", plan) and end - start < len(wanted) / 2


def test_empty_listing(spark):
    pages = Listing(spark.createDataFrame([], SCHEMA), ["k"])
    assert len(pages) == 0 and pages.page(0, 5).count() == 0 and pages.page(7, 5).columns == ["k", "n", "_v"]
