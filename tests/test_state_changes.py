"""State kept as changes of runs: loading equals a plain replay, saves grow with the run, and writers at once do not meet."""

import random

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.plans import crawl
from sitesieve.session import claim
from sitesieve.sources import sinks, state
from sitesieve.sources.pages import as_pages

KINDS = {
    "visited": "site string, norm_url string", "pending": "site string, norm_url string, added bigint", "attempts": "site string, norm_url string, n bigint",
    "sites": "site string, priority int, stopped boolean, cause string",
}


def changes(spark, rows):
    """Changes from name to rows that end with ``gone``."""
    return {name: spark.createDataFrame(rows.get(name, []), f"{kind}, gone boolean") for name, kind in KINDS.items()}


def urls(numbers):
    return [(f"s{i % 5}", f"http://s{i % 5}/{i}") for i in numbers]


def written(spark, path, version, name="visited"):
    return spark.read.parquet(f"{path}/version={version}/{name}").count()


def test_load_equals_a_plain_replay(spark, tmp_path):
    random.seed(8)
    path, plain, history = str(tmp_path / "state"), {}, []
    for run in range(7):
        fresh = random.sample(range(1000), 120)
        add = [(*u, run, False) for u in urls(fresh)]
        drop = [(*u, None, True) for u in urls(random.sample(range(1000), 40)) if u[1] not in {a[1] for a in add}]
        version = state.save_changes(changes(spark, {"pending": add + drop, "visited": [(*u, False) for u in urls(range(run * 50, run * 50 + 50))]}), path, compact_every=2)
        assert version == run
        for site, url, n, gone in add + drop:
            plain.pop(url, None)
            if not gone:
                plain[url] = (site, url, n)
        history.append(sorted(plain.values()))
        # every third version is whole again, the others hold only what changed
        assert written(spark, path, run) == (50 if run % 3 else 50 * (run + 1))
    for version, expected in enumerate(history):
        found = state.load_state(spark, path, version)
        assert sorted(tuple(r) for r in found["pending"].select("site", "norm_url", "added").collect()) == expected
        assert found["visited"].count() == 50 * (version + 1)


def test_third_save_is_in_proportion_to_its_run(spark, tmp_path):
    path = str(tmp_path / "state")
    for numbers in (range(3000), range(3000, 4000), range(4000, 4010)):
        state.save_changes(changes(spark, {"visited": [(*u, False) for u in urls(numbers)]}), path)
    assert [written(spark, path, v) for v in range(3)] == [3000, 1000, 10]
    loaded = state.load_state(spark, path)
    asked = spark.createDataFrame([(u, i) for i, (_, u) in enumerate(urls(range(3990, 6000)))], "norm_url string, part int")
    left = state.not_visited(asked, loaded)
    assert left.columns == ["norm_url", "part"] and sorted(r.part for r in left.collect()) == list(range(20, 2010))
    # most new URLs are told by the filter alone, and only ranges with a set bit are opened
    one = state.not_visited(asked.filter("part = 3"), loaded)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 0 and "PartitionFilters: [isnotnull(part" in plan


def test_visited_url_that_opens_again(spark, tmp_path):
    path = str(tmp_path / "state")
    state.save_changes(changes(spark, {"visited": [("a", "http://a/1", False), ("a", "http://a/2", False)]}), path)
    state.save_changes(changes(spark, {"visited": [("a", "http://a/1", True)]}), path)
    loaded = state.load_state(spark, path)
    assert [r.norm_url for r in loaded["visited"].collect()] == ["http://a/2"]
    asked = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://a/3",), (None,)], "norm_url string")
    assert {r.norm_url for r in state.not_visited(asked, loaded).collect()} == {"http://a/1", "http://a/3", None}


def test_empty_state(spark, tmp_path):
    path = str(tmp_path / "state")
    for version in range(2):
        assert state.save_changes(changes(spark, {}), path) == version
        loaded = state.load_state(spark, path)
        assert all(loaded[name].count() == 0 for name in KINDS)
        assert state.not_visited(spark.createDataFrame([("u",)], "norm_url string"), loaded).count() == 1


def test_changes_of_runs_equal_whole_states(spark, tmp_path):
    config = SieveConfig(langs_of_interest=("en",), user_agent="Bot", accepted_tlds=("com",), max_attempts=1, scout_steps=4, min_langs_in_site=1, max_size_per_site=1)
    random.seed(3)
    whole, log, number = str(tmp_path / "whole"), str(tmp_path / "log"), 0
    for run in range(4):
        rows = []
        for _ in range(40):
            number += 1
            site = random.choice("abcde")
            link = f'<a href="/{random.randrange(60)}">the</a><a href="http://{random.choice("abcdefg")}.com/{random.randrange(30)}">'
            status = random.choice((200, 200, 200, 408, 428, 404, 301))
            rows.append((number, f"http://{site}.com/{random.randrange(60)}", status, link if status == 200 else ""))
        pages = as_pages(spark.createDataFrame(rows, "fetch_seq bigint, url string, status int, html string").withColumn("fetch_ts", F.lit("2024-01-01").cast("timestamp_ntz")))
        before = state.load_state(spark, whole)
        known = state.load_state(spark, log)
        if before is None:
            first = crawl.next_state(crawl.run(pages, config, {"en": ["the"]}), config)
            state.save_state(first, whole)
            state.save_changes({k: v.withColumn("gone", F.lit(False)) for k, v in first.items()}, log)
        else:
            done = crawl.run(pages, config, {"en": ["the"]}, visited=before["visited"])
            state.save_state(crawl.next_state(done, config, before), whole)
            state.save_changes(crawl.next_changes(done, config, known), log, compact_every=2)
        a, b = state.load_state(spark, whole), state.load_state(spark, log)
        for name, kind in KINDS.items():
            columns = [c for c in a[name].columns if c != "part"]
            rows_a, rows_b = (sorted(str(tuple(r)) for r in s[name].select(*columns).collect()) for s in (a, b))
            assert rows_a == rows_b, (run, name)


def test_claims(spark, tmp_path):
    assert claim(spark, f"{tmp_path}/x/one") and not claim(spark, f"{tmp_path}/x/one") and claim(spark, f"{tmp_path}/x/two")


@pytest.mark.parametrize("later", ["documents", "state"])
def test_two_writers_between_check_and_write(spark, tmp_path, monkeypatch, later):
    """The second writer runs as a whole after the first has looked and before it writes."""
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([("a.com", i, f"http://a.com/{i}", "en") for i in range(4)], "site string, fetch_seq bigint, norm_url string, lang string")
    if later == "documents":
        look, module, name = sinks.runs, sinks, "runs"
        write = lambda rows: sinks.write_documents(docs.filter(f"fetch_seq >= {rows}"), path)
    else:
        look, module, name = state._versions, state, "_versions"
        write = lambda rows: state.save_changes(changes(spark, {"visited": [(*u, False) for u in urls(range(rows))]}), path)
    inner = []

    def looks(*args):
        found = look(*args)
        monkeypatch.setattr(module, name, look)
        inner.append(write(2))
        return found

    monkeypatch.setattr(module, name, looks)
    outer = write(0 if later == "documents" else 3)
    assert sorted((outer, *inner)) == [0, 1] and inner == [0]
    if later == "documents":
        found = sinks.read_documents(spark, path)
        assert {(r.run_id, r.n) for r in found.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {(0, 2), (1, 4)}
    else:
        assert [state.load_state(spark, path, v)["visited"].count() for v in (0, 1)] == [2, 3]
