"""Sinks, state and streams."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.plans.queries import QUERIES
from sitesieve.operators import frontier, links, pages, scout
from sitesieve.sources import sinks, state
from sitesieve.sources.pages import as_pages
from sitesieve.streaming.evidence import read_evidence, stream_evidence, write_evidence
from sitesieve.streaming.frontier import stream_frontier, write_frontier
from sitesieve.streaming.pages import stream_parquet
from sitesieve.streaming.scout import read_scouted, stream_scout

CONFIG = SieveConfig(langs_of_interest=("en", "fr"), user_agent="Bot", scout_steps=6, mandatory_lang="fr", accepted_tlds=("com",))


def documents(spark, n=30):
    rows = [(f"s{i % 3}.com", i, f"http://s{i % 3}.com/{i}", 200, None, "utf-8", "en", f"<p>\t{i}\n") for i in range(n)]
    return spark.createDataFrame(
        rows, "site string, fetch_seq bigint, norm_url string, status int, content_type string, encoding string, lang string, html string"
    )


@pytest.mark.parametrize("per_site", [False, True])
def test_document_sink(spark, tmp_path, per_site):
    path = str(tmp_path / "documents")
    docs = documents(spark)
    assert sinks.write_documents(docs, path, per_site=per_site) == 0
    assert sinks.write_documents(docs.limit(4), path, per_site=per_site) == 1
    back = sinks.read_documents(spark, path)
    first = back.filter("run_id = 0").select(*docs.columns)
    assert sorted(map(tuple, first.collect()), key=lambda r: r[1]) == sorted(map(tuple, docs.collect()), key=lambda r: r[1])
    assert back.filter("run_id = 1").count() == 4
    one = sinks.read_documents(spark, path, "s1.com").filter("run_id = 0")
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "site" in folders if per_site else "site_bucket" in folders and "EqualTo(site,s1.com)" in plan
    with pytest.raises(ValueError, match="exists"):
        sinks.write_documents(docs, path, run_id=1)
    with pytest.raises(ValueError, match="laid out"):
        sinks.write_documents(docs, path, per_site=not per_site)


def test_runs_without_documents_and_failed_runs(spark, tmp_path):
    path = str(tmp_path / "documents")
    docs = documents(spark)
    assert sinks.next_run_id(spark, path) == 0
    assert sinks.write_documents(docs.limit(0), path) == 0
    assert sinks.read_documents(spark, path).collect() == []
    docs.write.parquet(f"{path}/run_id=1/site_bucket=0")  # a run that did not come to its end
    assert sinks.read_documents(spark, path).count() == 0
    assert sinks.write_documents(docs.limit(3), path) == 1
    assert sinks.write_documents(docs.limit(0), path) == 2
    assert sinks.read_documents(spark, path).count() == 3
    out = str(tmp_path / "metadata")
    sinks.write_metadata_of_run(spark, path, out, 1)
    assert sinks.read_metadata(spark, out, 1).count() == 3


def test_metadata_sink(spark, tmp_path):
    path = str(tmp_path / "metadata")
    docs = documents(spark)
    sinks.write_metadata(docs, path, 0)
    back = sinks.read_metadata(spark, path, 0)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sinks.metadata_rows(docs).collect()))
    assert list((tmp_path / "metadata" / "run_id=0").glob("*.gz"))


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.load_state(spark, path) is None
    urls = spark.createDataFrame([("a.com", "http://a.com/1"), ("b.com", "http://b.com/1")], "site string, norm_url string")
    sites = urls.select("site", F.lit(0).alias("priority"), F.lit(False).alias("stopped"), F.lit("running").alias("cause"))
    tables = {"visited": urls, "pending": urls.limit(1), "attempts": urls.withColumn("n", F.lit(2)), "sites": sites}
    assert state.save_state(tables, path) == 0
    loaded = state.load_state(spark, path)
    # the next version is computed from the one before
    grown = {**loaded, "visited": loaded["visited"].unionByName(urls.withColumn("site", F.lit("c.com")))}
    assert state.save_state(grown, path) == 1
    assert state.load_state(spark, path)["visited"].count() == 4
    assert state.load_state(spark, path, 0)["visited"].count() == 2
    assert state.load_state(spark, path)["attempts"].first().n == 2


def kept(spark, n=120):
    random.seed(2)
    rows = []
    for i in range(n):
        site = "hot.com" if i % 3 else random.choice(["a.com", "b.com", "c.com"])
        lang = "en" if site in ("hot.com", "a.com") else random.choice(["en", "fr"])
        rows.append((site, lang, i))
    return spark.createDataFrame(rows, "site string, lang string, fetch_seq bigint")


def write_in_order(table, path, parts, of):
    """One file per range of ``fetch_seq``, written one after the other."""
    step = 120 // of
    for part in parts:
        table.filter(F.col("fetch_seq").between(part * step, (part + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 4, 12])
def test_stream_scout_equals_batch_and_restarts(spark, tmp_path, files):
    source, out, kept_state = (str(tmp_path / name) for name in ("in", "out", "state"))
    table = kept(spark)
    half = max(files // 2, 1)
    for parts in (range(half), range(half, files)):
        write_in_order(table, source, parts, files)
        stream = stream_parquet(spark, source, table.schema, max_files=1)
        stream_scout(stream, CONFIG, out, kept_state).awaitTermination()
    found = sorted(map(tuple, read_scouted(spark, out).select("site", "lang", "fetch_seq").collect()))
    expected = sorted(map(tuple, scout.run_scout(table, CONFIG).collect()))
    assert found == expected
    assert len(expected) < 120


def test_stream_evidence_equals_batch_and_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    table = kept(spark)
    for parts in (range(2), range(2, 4)):
        write_in_order(table, source, parts, 4)
        write_evidence(stream_evidence(stream_parquet(spark, source, table.schema, max_files=1)), out, checkpoint).awaitTermination()
    assert sorted(map(tuple, read_evidence(spark, out).collect())) == sorted(map(tuple, scout.lang_evidence(table).collect()))


def fetched(spark, numbers):
    rows = [(i, f"http://w{i % 5}.com/{i}", f'<a href="/x{i % 7}"><a href="/y{i}"><a href="http://w{(i + 1) % 5}.com/{i}">', f"2024-01-01 00:00:{i:02d}") for i in numbers]
    table = spark.createDataFrame(rows, "fetch_seq bigint, url string, html string, t string")
    return table.withColumn("fetch_ts", F.to_timestamp("t")).drop("t")


@pytest.mark.parametrize("event_time", [None, "fetch_ts"])
def test_stream_frontier_equals_batch_and_restarts(spark, tmp_path, event_time):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for numbers in (range(0, 10), range(10, 40)):
        fetched(spark, numbers).write.mode("append").parquet(source)
        stream = stream_parquet(spark, source, fetched(spark, []).schema, max_files=2)
        write_frontier(stream_frontier(stream, CONFIG, event_time=event_time), out, checkpoint).awaitTermination()
    found = [r.norm_url for r in spark.read.parquet(out).collect()]
    batch = links.admitted(links.admit_links(links.with_link_parts(pages.page_links(pages.with_site(fetched(spark, range(40))))), CONFIG))
    expected = [r.norm_url for r in frontier.dedup_links(batch).collect()]
    assert len(found) == len(set(found))
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("layout", ["file", "folder", "empty"])
def test_stream_links_of_a_table_in_one_file_or_in_a_folder(spark, tmp_path, layout):
    rows = [(i, f"http://w{i % 3}.com/en/{i}", f'<a href="/en/x{i % 4}">x</a><a href="http://v{i}.org/">v</a>') for i in range(24)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    written = tmp_path / "written"
    (table.limit(0) if layout == "empty" else table).repartition(1 if layout == "file" else 4).write.parquet(str(written))
    # another table lies next to it
    table.write.parquet(str(tmp_path / "tables" / "documents.parquet"))
    target = tmp_path / "tables" / "pages.parquet"
    if layout == "file":
        shutil.copy(next(written.glob("*.parquet")), target)
    else:
        shutil.copytree(written, target)
    got = sorted(map(tuple, QUERIES["stream_links"](spark, str(tmp_path / "tables")).collect()))
    expected = [(f"http://w{k}.com/en/x{j}", f"w{k}.com") for k in range(3) for j in range(4)] + [(f"http://v{i}.org/", f"v{i}.org") for i in range(24)]
    assert got == ([] if layout == "empty" else sorted(expected))
