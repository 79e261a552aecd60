"""Scout policies that fold any column: batch, stream and a plain loop agree."""

import random

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.operators import scout
from sitesieve.operators.scout import Measure, SitePolicy
from sitesieve.plans import crawl, inputs
from sitesieve.sources.pages import as_pages
from sitesieve.streaming.pages import stream_parquet
from sitesieve.streaming.scout import read_scouted, stream_scout

CONFIG = SieveConfig(langs_of_interest=("en", "fr"), user_agent="Bot", scout_steps=7, mandatory_lang="fr", min_percent_mandatory_lang=20)
POLICY = SitePolicy(
    {"docs": Measure("1"), "size": Measure("n_bytes"), "langs": Measure("lang", "distinct"), "least": Measure("n_bytes", "min"), "most": Measure("n_bytes", "max")},
    ready=lambda s: (s["size"] >= 300) & (s["most"] >= 80),
    keep=lambda s: (s["langs"] >= 3) | (s["least"] > 10),
)
SCHEMA = "site string, lang string, fetch_seq bigint, n_bytes bigint"


def documents(n, seed=4):
    random.seed(seed)
    rows = []
    for i in range(n):
        site = "hot" if i % 3 else random.choice("abcdefgh")
        lang = random.choice(("en", "fr", None) if site in "abc" else ("en", "en", "en", "fr", "es"))
        rows.append((site, lang, i * 3, random.choice((None, 0, 5, 20, 90) if site in "ad" else (11, 30, 95))))
    return rows


def plain(rows):
    state, verdict, passing = {}, {}, []
    for site, lang, seq, size in sorted(rows, key=lambda r: r[2]):
        if verdict.get(site, (True, True))[1]:
            passing.append((site, lang, seq, size))
        if site not in verdict:
            docs, total, langs, least, most = state.get(site, (0, 0, frozenset(), None, None))
            langs = langs | {lang} if lang else langs
            if size is not None:
                total, least, most = total + size, size if least is None else min(least, size), size if most is None else max(most, size)
            state[site] = docs + 1, total, langs, least, most
            if total >= 300 and most is not None and most >= 80:
                keep = len(langs) >= 3 or least > 10
                verdict[site] = (seq, keep)
    out = set()
    for site, (docs, total, langs, least, most) in state.items():
        seq, keep = verdict.get(site, (None, True))
        out.add((site, docs, total, len(langs), least, most, site in verdict, keep, None if keep else seq))
    return out, passing


@pytest.mark.parametrize("span", [1 << 18, 40, 7])
def test_decision_equals_a_plain_loop(spark, span):
    rows = documents(700) + [("z", "en", 99_999, 5)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(r) for r in scout.policy_decision(scout.measured(table, POLICY), POLICY, span).collect()}
    expected, passing = plain(rows)
    assert got == expected and {r[6] for r in got} == {True, False} and {r[7] for r in got} == {True, False}
    assert sorted(map(str, scout.run_policy(table, POLICY).collect())) == sorted(map(str, spark.createDataFrame(passing, SCHEMA).collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_a_plain_loop(spark, tmp_path, files):
    rows, out, state = documents(240), str(tmp_path / "out"), str(tmp_path / "state")
    table = spark.createDataFrame(rows, SCHEMA)
    for part in range(files):
        source = str(tmp_path / "in" / f"part={part}")
        table.filter(F.floor(F.col("fetch_seq") * files / 720) == part).repartition(2).write.parquet(source)
        stream_scout(stream_parquet(spark, str(tmp_path / "in" / "*"), table.schema), CONFIG, out, state, POLICY).awaitTermination()
    got = sorted(str(tuple(r)) for r in read_scouted(spark, out).select("site", "lang", "fetch_seq", "n_bytes").collect())
    assert got == sorted(str(r) for r in plain(rows)[1])


def test_many_batches_leave_a_bounded_number_of_state_files(spark, tmp_path):
    rows, source, out, state = documents(150), str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    table = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for part in range(50):
            table.filter(F.expr("fetch_seq div 9") == part).coalesce(1).write.mode("append").parquet(source)
        stream_scout(stream_parquet(spark, source, table.schema, max_files=1), CONFIG, out, str(state), POLICY).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {p.name for p in state.iterdir()} == {"checkpoint"}
    got = sorted(str(tuple(r)) for r in read_scouted(spark, out).select("site", "lang", "fetch_seq", "n_bytes").collect())
    assert got == sorted(str(r) for r in plain(rows)[1])


def test_language_policy_is_the_usual_scout(spark):
    rows = [(s, l or "en", i, 1) for s, l, i, _ in documents(200)]
    table = spark.createDataFrame(rows, SCHEMA)
    usual = scout.scout_decision(scout.scout_steps(table, CONFIG.scout_steps), CONFIG)
    folded = scout.policy_decision(scout.measured(table, policy := scout.language_policy(CONFIG)), policy, 50)
    columns = ["site", "n_steps", "n_langs", "n_mandatory", "judged", "keep", "stop_seq"]
    assert {tuple(r) for r in usual.select(*columns).collect()} == {tuple(r) for r in folded.select(*columns).collect()}


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scout.policy_decision(scout.measured(empty, POLICY), POLICY).count() == 0
    with pytest.raises(ValueError, match="merge"):
        Measure("1", "product")


def test_run_with_a_policy_over_the_text(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.com/{i}", f"<p>the {'buy ' if i % 2 else ''}{'word ' * i}<a href='/l{i}'>") for i in range(20)]
    pages = as_pages(spark.createDataFrame(rows, "fetch_seq bigint, url string, html string"))
    policy = SitePolicy(
        {"buys": Measure("cast(contains(html, 'buy') AS bigint)"), "docs": Measure("1")}, ready=lambda s: s["docs"] >= 3, keep=lambda s: s["buys"] < 2
    )
    config = SieveConfig(langs_of_interest=("en",), user_agent="Bot", lang_min_share=(100, 1))
    done = crawl.run(pages, config, {"en": ["the"]}, policy=policy)
    assert {r.site: (r.cause, r.stop_seq) for r in done.sites.collect()} == {"a.com": ("running", None), "b.com": ("scout", 5)}
    assert {r.fetch_seq for r in done.documents.collect()} == {*range(0, 20, 2), 1, 3, 5}
    assert set(done.documents.columns) == {*pages.columns, "n_bytes", "encoding", "norm_url", "lang", "host", "site"}


def test_text_is_read_once_and_never_shuffled(spark, monkeypatch):
    """The only scan of the source with text is that of the pass that writes the buckets; no exchange of a run carries text."""
    written = []
    keep = crawl.bucketed

    def bucketed(df, name, key, n):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name, key, n)

    monkeypatch.setattr(crawl, "bucketed", bucketed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sf = "/root/testdata/sf0.001"
        done = crawl.run(inputs.fetched(spark, sf), inputs.CONFIG, inputs.model(spark, sf), inputs.robots_files(spark, sf))
        plans = {
            name: getattr(done, name)._jdf.queryExecution().executedPlan().toString()
            for name in ("documents", "admitted", "judged", "sites", "pending", "seeds")
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    passes = [plan for name, plan in written if name == "read"]
    assert len(passes) == 1 and "Exchange" not in passes[0] and passes[0].count("FileScan parquet") == 1
    for name, plan in plans.items():
        assert "testdata" not in plan, name
        for line in plan.splitlines():
            if "FileScan" in line and "html" in line:
                assert name == "documents" and "Bucketed: true" in line, line
    assert "Exchange" not in plans["documents"] and "ShuffledHashJoin" in plans["documents"]
