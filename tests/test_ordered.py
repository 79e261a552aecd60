"""Ordered computations per key against plain loops, with one key that holds most rows and blocks that are small."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sitesieve.operators import ordered


def sample(n=400, seed=5):
    random.seed(seed)
    seqs = random.sample(range(3 * n), n)
    return [("hot" if random.random() < 0.7 else random.choice("abc"), s, random.randint(0, 9)) for s in seqs]


def by_key(rows):
    for key, group in groupby(sorted(rows), key=lambda r: r[0]):
        yield key, list(group)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sample(), "k string, seq bigint, v int").repartition(3)


@pytest.mark.parametrize("span", [1, 7, 50, 100_000])
def test_running_before_and_numbered(table, span):
    expected = {}
    for key, group in by_key(sample()):
        total = 0
        for place, (_, seq, v) in enumerate(group, start=1):
            expected[key, seq] = (total, place)
            total += v
    out = ordered.numbered(ordered.running_before(table, ["k"], "seq", F.col("v"), "before", span), ["k"], "seq", "n", span)
    assert {(r.k, r.seq): (r.before, r.n) for r in out.collect()} == expected


@pytest.mark.parametrize("span", [1, 7, 50, 100_000])
def test_previous(table, span):
    expected = {}
    for key, group in by_key(sample()):
        last = None
        for _, seq, v in group:
            expected[key, seq] = last
            last = v
    out = ordered.previous(table, ["k"], "seq", "v", "p", span)
    assert {(r.k, r.seq): r.p for r in out.collect()} == expected


@pytest.mark.parametrize("span", [1, 7, 50, 100_000])
@pytest.mark.parametrize("limit", [-1, 0, 40, 300, 10_000])
def test_first_over(table, span, limit):
    expected = {}
    for key, group in by_key(sample()):
        total = 0
        for _, seq, v in group:
            total += v
            if total > limit:
                expected[key] = seq
                break
    out = ordered.first_over(table, ["k"], "seq", F.col("v"), limit, span)
    assert {r.k: r.stop_seq for r in out.collect()} == expected


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_top_per_key(table, k):
    expected = {(key, seq): place for key, group in by_key(sample()) for place, (_, seq, _) in enumerate(group, 1) if place <= k}
    out = ordered.top_per_key(table, ["k"], [F.asc("seq")], k, "place", spread=4)
    assert {(r.k, r.seq): r.place for r in out.collect()} == expected


def test_numbered_overall_with_ties(spark):
    rows = [(i // 3, chr(97 + i % 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "seq bigint, name string").repartition(4)
    out = ordered.numbered_overall(table, "seq", "n", 5, ["name"])
    assert [(r.seq, r.name) for r in out.orderBy("n").collect()] == rows
    assert [r.n for r in out.orderBy("n").collect()] == list(range(1, 61))


def test_negative_order_keeps_the_order(spark):
    table = spark.createDataFrame([("a", -i) for i in range(40)], "k string, seq bigint")
    out = ordered.numbered(table, ["k"], "seq", "n", 6).orderBy("n").collect()
    assert [r.seq for r in out] == sorted(-i for i in range(40))


def test_result_does_not_depend_on_partitions(table):
    one = ordered.first_over(table.coalesce(1), ["k"], "seq", F.col("v"), 40, 7).collect()
    many = ordered.first_over(table.repartition(11), ["k"], "seq", F.col("v"), 40, 7).collect()
    assert sorted(one) == sorted(many)


def test_many_rows_of_one_number_are_spread(spark):
    """One site, one number and many URLs: the order within the number comes from the URL, and no block has them all."""
    from sitesieve.operators import budgets

    rows = spark.range(5000).selectExpr("'a.com' AS site", "concat('http://a.com/', id) AS norm_url", "7L AS added")
    delays = spark.createDataFrame([("a.com", 2)], "site string, delay int")
    slots = budgets.fetch_slots(rows, delays, F.lit("2024-01-01").cast("timestamp_ntz")).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1, 5001))
    assert [r.norm_url for r in slots] == sorted(f"http://a.com/{i}" for i in range(5000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = ordered.running_before(rows, ["site"], "added", F.lit(1), "n", tie=["norm_url"])
        blocks = ordered.ranged_blocks(rows, ["site"], "added", ["norm_url"]).groupBy("__block").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranged.agg(F.sum("n")).first()[0] == 5000 * 4999 // 2
    assert len(blocks) > 1 and max(r["count"] for r in blocks) < 3000


def test_cut_before_the_one_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id")
    plan = ordered.top_per_key(rows, ["k"], [F.asc("id")], 5, "place")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Partial" in plan
