"""Registered queries: SQL counterparts, plans, and properties of the whole run."""

import glob
import os
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from sitesieve.plans import crawl, inputs
from sitesieve.plans.oracle import ORACLE_SQL
from sitesieve.plans.queries import QUERIES
from sitesieve.session import shared_dir

SMALL = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(entry_points.oracle_sql())
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SMALL)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [columns.index(c) for c in df.columns]
    expected = sorted(str(tuple(row[i] for i in order)) for row in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3


def test_no_python_and_no_cross_join_in_batch_plans(spark):
    for name in ("link_admission", "page_lang", "lang_scores", "robots_allowed", "scout_apply", "site_status", "fetch_slots", "delay_audit"):
        plan = entry_points.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_url_queries_do_not_read_the_text(spark):
    for name in ("site_domain", "url_normalise", "status_actions", "scout_percent"):
        plan = entry_points.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert ("html" in plan) == (name == "scout_percent"), name


def test_outcomes_cover_all_pages(spark):
    judged = crawl.judge_pages(inputs.fetched(spark, SMALL), inputs.CONFIG, inputs.model(spark, SMALL))
    assert judged.count() == inputs.table(spark, SMALL, "pages").count()


def test_run_properties(spark):
    pages = inputs.fetched(spark, SMALL, with_location=True)
    model, files = inputs.model(spark, SMALL), inputs.robots_files(spark, SMALL)
    done = crawl.run(pages, inputs.CONFIG, model, files)
    kept = {r.fetch_seq for r in done.judged.filter("outcome = 'kept'").collect()}
    documents = {r.fetch_seq for r in done.documents.collect()}
    assert documents == {r.fetch_seq for r in done.judged.filter("outcome = 'kept' AND NOT after_stop").collect()}
    pending = [r.norm_url for r in done.pending.collect()]
    assert len(pending) == len(set(pending))
    assert not set(pending) & {r.norm_url for r in done.judged.collect()}
    fewer = None
    for megabytes in (0.005, 0.02, 10):
        some = crawl.run(pages, replace(inputs.CONFIG, max_size_per_site=megabytes), model, files)
        found = {r.fetch_seq for r in some.documents.collect()}
        assert found <= kept and (fewer is None or fewer <= found)
        fewer = found
    assert fewer == documents
    timed = crawl.run(pages, replace(inputs.CONFIG, max_time_per_site=60), model, files)
    assert {r.cause for r in timed.sites.collect()} == {"time"}
    again = crawl.run(pages, inputs.CONFIG, model, files, visited=done.pending.select("norm_url"))
    assert again.pending.count() == 0


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_state_carries_attempts_over_runs(spark, tmp_path):
    from sitesieve.config import SieveConfig
    from sitesieve.sources import state
    from sitesieve.sources.pages import as_pages

    config = SieveConfig(langs_of_interest=("en",), user_agent="Bot", max_attempts=1)
    path = str(tmp_path / "state")
    pages = as_pages(
        spark.createDataFrame(
            [(1, "http://a.com/slow", 408, ""), (2, "http://a.com/gone", 404, ""), (3, "http://a.com/", 200, '<a href="/new">the')],
            "fetch_seq bigint, url string, status int, html string",
        )
    )
    seeds = spark.createDataFrame([(0, "http://b.com"), (1, "http://a.com/gone")], "seed_seq bigint, url string")
    counts = []
    for _ in range(4):
        before = state.load_state(spark, path)
        done = crawl.run(pages, config, {"en": ["the"]}, visited=before and before["visited"], seeds=seeds)
        state.save_state(crawl.next_state(done, config, before), path)
        now = state.load_state(spark, path)
        pending = {r.norm_url for r in now["pending"].collect()}
        visited = {r.norm_url for r in now["visited"].collect()}
        counts.append((now["attempts"].agg(F.max("n")).first()[0], "http://a.com/slow" in pending))
        assert {"http://a.com/gone", "http://a.com/"} <= visited
        assert {"http://a.com/new", "http://b.com"} <= pending
        assert ("http://a.com/slow" in visited) != ("http://a.com/slow" in pending)
    # one failure and max_attempts more are retried, the next one gives up, and the count starts anew
    assert counts == [(1, True), (2, True), (None, False), (1, True)]
