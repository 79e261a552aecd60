"""Early stop, budgets, attempts and pacing."""

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.operators import budgets, scout


def config(**options):
    return SieveConfig(langs_of_interest=("en", "fr"), user_agent="Bot", **options)


def kept(spark, langs, site="s"):
    rows = [(site, lang, i) for i, lang in enumerate(langs)]
    return spark.createDataFrame(rows, "site string, lang string, fetch_seq bigint")


def verdict(spark, langs, **options):
    c = config(**options)
    row = scout.scout_decision(scout.scout_steps(kept(spark, langs), c.scout_steps), c).first()
    return row.judged, row.keep, row.stop_seq


@pytest.mark.parametrize(
    "langs, options, expected",
    [
        (["en"] * 9, dict(scout_steps=10), (False, True, None)),
        (["en"] * 10, dict(scout_steps=10), (True, False, 9)),
        (["en"] * 10 + ["fr"] * 5, dict(scout_steps=10), (True, False, 9)),
        (["en"] * 9 + ["fr"], dict(scout_steps=10), (True, True, None)),
        (["en"] * 9 + ["fr"], dict(scout_steps=10, mandatory_lang="fr"), (True, True, None)),
        (["en"] * 9 + ["fr"], dict(scout_steps=10, mandatory_lang="fr", min_percent_mandatory_lang=11), (True, False, 9)),
        # 3 of 31 is 9.67 percent, cut to 9
        (["en"] * 28 + ["fr"] * 3, dict(scout_steps=31, mandatory_lang="fr"), (True, False, 30)),
        (["en"] * 28 + ["fr"] * 3, dict(scout_steps=31, mandatory_lang="fr", min_percent_mandatory_lang=9), (True, True, None)),
        (["en"] * 5 + ["fr"] * 5, dict(scout_steps=10, mandatory_lang="de", min_percent_mandatory_lang=0), (True, False, 9)),
        (["en"] * 10, dict(scout_steps=10, min_langs_in_site=1), (True, True, None)),
    ],
)
def test_decision(spark, langs, options, expected):
    assert verdict(spark, langs, **options) == expected


def test_apply_keeps_the_deciding_page_and_other_sites(spark):
    c = config(scout_steps=3)
    both = kept(spark, ["en"] * 6).unionByName(kept(spark, ["en", "fr"] * 3, "t"))
    out = scout.run_scout(both, c)
    assert sorted((r.site, r.fetch_seq) for r in out.collect()) == [("s", i) for i in range(3)] + [("t", i) for i in range(6)]


def test_another_policy(spark):
    c = config(scout_steps=3)
    out = scout.run_scout(kept(spark, ["en"] * 6), c, policy=lambda options: F.col("n_steps") >= options.scout_steps)
    assert out.count() == 6


def test_size_budget(spark):
    rows = [("s", i, 400_000) for i in range(5)] + [("t", i, 500_000) for i in range(2)]
    table = spark.createDataFrame(rows, "site string, fetch_seq bigint, n_bytes bigint")
    for span in (1, 2, 100):
        assert {r.site: r.stop_seq for r in budgets.size_budget(table, 1, span).collect()} == {"s": 2}
    wide = budgets.size_budget(table, 0)
    assert {r.site: r.stop_seq for r in wide.collect()} == {"s": 0, "t": 0}
    assert budgets.size_budget(table, 2).count() == 0


def stamped(spark, rows):
    table = spark.createDataFrame(rows, "site string, fetch_seq bigint, second int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table.withColumn("fetch_ts", start + F.make_dt_interval(secs=F.col("second"))).drop("second")


def test_time_budget(spark):
    pages = stamped(spark, [("s", 0, 5), ("s", 1, 15), ("s", 2, 16), ("s", 3, 40), ("t", 0, 0), ("t", 1, 10)])
    assert {r.site: r.stop_seq for r in budgets.time_budget(pages, 10).collect()} == {"s": 2}
    starts = stamped(spark, [("s", 0, 0), ("t", 0, 0)]).select("site", F.col("fetch_ts").alias("crawl_starts"))
    assert {r.site: r.stop_seq for r in budgets.time_budget(pages, 9, starts).collect()} == {"s": 1, "t": 1}


def stops(spark, rows):
    return spark.createDataFrame(rows, "site string, stop_seq bigint")


def test_site_status_order(spark):
    sites = spark.createDataFrame([(c, 50) for c in "abcde"], "site string, last_seq bigint")
    status = budgets.site_status(
        sites, stops(spark, [("a", 5), ("b", None)]), stops(spark, [("a", 5), ("b", 7)]), stops(spark, [("a", 4), ("b", 7)]),
        stops(spark, [("c", 0)]).select("site"),
    )
    assert {r.site: (r.cause, r.stop_seq) for r in status.collect()} == {
        "a": ("time", 4), "b": ("size", 7), "c": ("exhausted", 50), "d": ("running", None), "e": ("running", None),
    }
    assert {r.cause for r in budgets.site_status(sites).collect()} == {"running"}


def test_exhausted(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    pending = spark.createDataFrame([("b", "u")], "site string, norm_url string")
    assert [r.site for r in budgets.exhausted_sites(sites, pending).collect()] == ["a"]


@pytest.mark.parametrize("n, expected", [(1, "retry"), (2, "retry"), (4, "retry"), (5, "given_up"), (9, "given_up")])
def test_attempts(spark, n, expected):
    log = spark.createDataFrame([("u", i, "retry") for i in range(1, n + 1)], "norm_url string, attempt int, action string")
    assert budgets.attempt_state(log, 3).first().state == expected


def test_final_failure(spark):
    log = spark.createDataFrame([("u", 1, "retry"), ("u", 2, "fail"), ("v", 1, "fail"), ("w", 1, "wait")], "norm_url string, attempt int, action string")
    assert {r.norm_url: r.state for r in budgets.attempt_state(log, 3).collect()} == {"u": "failed", "v": "failed", "w": "retry"}


def test_retry_wait(spark):
    rows = spark.createDataFrame([(1, 428, "7"), (2, 413, None), (3, 428, "soon"), (4, 429, "7")], "fetch_seq bigint, status int, retry_after string")
    stamped_rows = rows.withColumn("fetch_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    out = {r.fetch_seq: str(r.wait_until) for r in budgets.retry_wait(stamped_rows).collect()}
    assert out == {1: "2024-01-01 00:00:07", 2: "2024-01-01 00:08:20", 3: "2024-01-01 00:08:20"}


def test_slots_and_audit(spark):
    pending = spark.createDataFrame([("s", f"u{i}", i) for i in range(5)] + [("t", "v", 9)], "site string, norm_url string, added bigint")
    delays = spark.createDataFrame([("s", 10), ("t", 3)], "site string, delay int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = budgets.fetch_slots(pending, delays, start, span=2)
    assert sorted((r.site, r.slot, r.norm_url, str(r.fetch_at)[-5:]) for r in out.collect()) == [
        ("s", i + 1, f"u{4 - i}", f"00:{10 * i:02d}") for i in range(5)
    ] + [("t", 1, "v", "00:00")]
    pages = stamped(spark, [("s", 0, 0), ("s", 1, 10), ("s", 2, 19), ("s", 7, 40), ("s", 8, 41), ("t", 3, 0), ("t", 4, 2)])
    audit = budgets.delay_audit(pages, delays, span=3)
    assert sorted((r.site, r.fetch_seq, r.gap) for r in audit.collect()) == [("s", 2, 9), ("s", 8, 1), ("t", 4, 2)]
