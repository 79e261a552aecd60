"""Registered queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import content, urls
from ..operators import (
    budgets, frontier, grams, hosts, language, links, pages as page_ops, reach, robots, scout,
)
from ..session import new_path, stage, tune
from ..sources import seeds, sinks, state
from ..sources.pages import as_pages
from ..streaming.evidence import read_evidence, stream_evidence, write_evidence
from ..streaming.frontier import stream_frontier, write_frontier
from ..streaming.pages import stream_parquet, stream_table
from ..streaming.scout import read_scouted, stream_scout
from . import crawl, inputs
from .inputs import CONFIG

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = tuned
    return tuned


def _raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(inputs.table(spark, sf_dir, "pages"))


# Sources and sinks


@query
def pages_scan(spark, sf_dir):
    return inputs.fetched(spark, sf_dir).select(
        "fetch_seq", "url", "status", "content_type", F.octet_length("html").cast("bigint").alias("n_bytes")
    )


@query
def page_headers(spark, sf_dir):
    """Response columns read back from a header map with names in another case."""
    pages = inputs.fetched(spark, sf_dir)
    mapped = pages.select(
        "fetch_seq", "url", "html",
        F.map_from_arrays(
            F.array(F.lit("Content-TYPE"), F.lit("RETRY-after")), F.array("content_type", "retry_after")
        ).alias("headers"),
    )
    return as_pages(mapped).select("fetch_seq", "content_type", "retry_after")


@query
def seed_sites(spark, sf_dir):
    seeds = inputs.sited(spark, sf_dir).select(F.col("fetch_seq").alias("seed_seq"), "site")
    return frontier.seed_sites(seeds).select("site", "n_seeds", "first_seed", "priority")


@query
def seed_frontier(spark, sf_dir):
    """All page URLs as seeds."""
    seeds = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seed_seq"), "url")
    return frontier.seed_frontier(seeds).select("norm_url", "site", "added")


@query
def doc_metadata(spark, sf_dir):
    return sinks.metadata_rows(inputs.kept(spark, sf_dir))


@query
def document_sink(spark, sf_dir):
    """Kept documents written as a run and read back, after a run that kept none."""
    path = new_path(spark, "documents")
    kept = inputs.kept(spark, sf_dir, with_html=True)
    sinks.write_documents(kept.filter(F.lit(False)), path)
    sinks.write_documents(kept, path)
    return sinks.read_documents(spark, path).select(
        "run_id", "site", "fetch_seq", "norm_url", "lang", F.md5("html").alias("html_md5")
    )


@query
def metadata_sink(spark, sf_dir):
    """Metadata written from a finished run as compressed lines and read back."""
    path, lines = new_path(spark, "documents"), new_path(spark, "metadata")
    run = sinks.write_documents(inputs.kept(spark, sf_dir, with_html=True), path)
    sinks.write_metadata_of_run(spark, path, lines, run)
    return sinks.read_metadata(spark, lines, run)


@query
def state_tables(spark, sf_dir):
    """State saved and loaded: visited and pending URLs with their attempts."""
    pages = inputs.sited(spark, sf_dir)
    done = content.status_action("status") == "process"
    again = content.status_action("status").isin("retry", "wait")
    key = pages.select("site", "norm_url", done.alias("done"), again.alias("again"))
    path = new_path(spark, "state")
    running = F.lit("running").alias("cause")
    tables = {
        "sites": inputs.sites(spark, sf_dir).select("site", "priority", "stopped", running),
        "visited": key.filter("done").select("site", "norm_url").distinct(),
        "pending": key.filter("again").select("site", "norm_url").distinct(),
        "attempts": key.filter("again").groupBy("site", "norm_url").agg(F.count(F.lit(1)).alias("n")),
    }
    state.save_state(tables, path)
    loaded = state.load_state(spark, path)
    rows = [loaded[name].withColumn("state", F.lit(name)) for name in ("visited", "pending")]
    attempts = loaded["attempts"].withColumn("state", F.lit("attempts"))
    out = rows[0].unionByName(rows[1]).withColumn("n", F.lit(0).cast("bigint")).unionByName(attempts)
    return out.select("state", "site", "norm_url", "n")


@query
def state_versions(spark, sf_dir):
    """State after three runs over the first, second and last third of the pages, each saved as its changes and loaded by the next."""
    pages = inputs.sited(spark, sf_dir).withColumn("action", content.status_action("status"))
    pages = stage(pages.select("fetch_seq", "site", "norm_url", "action"), "fetches")
    low, high = pages.agg(F.min("fetch_seq"), F.max("fetch_seq")).first()
    path = new_path(spark, "state")
    for part in range(3):
        of_run = pages.filter(F.expr(f"(fetch_seq - {low}) * 3 div {high - low + 1}") == part)
        done = of_run.filter("action = 'process'").select("site", "norm_url").distinct()
        again = of_run.filter(F.col("action").isin("retry", "wait")).groupBy("site", "norm_url").agg(
            F.max("fetch_seq").alias("added"), F.count(F.lit(1)).alias("n")
        ).join(done.select("norm_url"), "norm_url", "left_anti")
        before = state.load_state(spark, path)
        if before is not None:
            done, again = state.not_visited(done, before), state.not_visited(again, before)
        added, gone = F.lit(False).alias("gone"), F.lit(True).alias("gone")
        changes = {
            "visited": done.select("*", added),
            "pending": again.select("site", "norm_url", "added", added).unionByName(done.select("site", "norm_url", F.lit(None).cast("bigint").alias("added"), gone)),
            "attempts": again.select("site", "norm_url", "n", added).unionByName(done.select("site", "norm_url", F.lit(None).cast("bigint").alias("n"), gone)),
            "sites": of_run.groupBy("site").agg(F.max("fetch_seq").alias("last")).select("*", added),
        }
        state.save_changes(changes, path)
    loaded = state.load_state(spark, path)
    none = F.lit(0).cast("bigint")
    rows = {
        "visited": loaded["visited"].select("site", "norm_url", none.alias("n")),
        "pending": loaded["pending"].select("site", "norm_url", F.col("added").alias("n")),
        "attempts": loaded["attempts"].select("site", "norm_url", "n"),
        "sites": loaded["sites"].select("site", F.lit("").alias("norm_url"), F.col("last").alias("n")),
    }
    out = [found.withColumn("state", F.lit(name)) for name, found in rows.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).select("state", "site", "norm_url", "n")


@query
def seed_file(spark, sf_dir):
    """Page URLs written as part files of seeds in the order of the pages, with blanks around them and blank lines in place of some (derived cases), and read
    back in that order."""
    path = new_path(spark, "seeds")
    pages = _raw_pages(spark, sf_dir)
    line = F.when(F.col("fetch_seq") % 9 == 4, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    pages.orderBy("fetch_seq").select(line.alias("value")).write.text(path)
    found = seeds.read_seeds(spark, path)
    return found.select("seed_seq", "url")


@query
def pages_with_text(spark, sf_dir):
    """Pages of which some have lost their text."""
    number = F.col("fetch_seq")
    text = F.when(number % 7 == 0, "").when(number % 11 == 1, F.lit(None)).otherwise(F.col("html"))
    return page_ops.non_empty(_raw_pages(spark, sf_dir).withColumn("html", text)).select("fetch_seq", "url")


@query
def page_prolog(spark, sf_dir):
    """Pages with an XML prolog before some of them, taken away again."""
    prolog = F.when(F.col("fetch_seq") % 2 == 0, '  <?xml version="1.0" encoding="utf-8"?>').otherwise("")
    written = _raw_pages(spark, sf_dir).select("fetch_seq", F.concat(prolog, "html").alias("html"))
    return written.select("fetch_seq", F.md5(content.without_prolog("html")).alias("html_md5"))


# URL functions


@query
def url_strip_fragment(spark, sf_dir):
    pages = _raw_pages(spark, sf_dir)
    return pages.select("fetch_seq", urls.strip_fragment("url").alias("stripped"))


@query
def url_normalise(spark, sf_dir):
    """Page URLs, and the same without their scheme."""
    pages = _raw_pages(spark, sf_dir)
    bare = F.regexp_replace("url", "^https?://", "")
    return pages.select("fetch_seq", urls.norm_url("url").alias("norm_url"), urls.norm_url(bare).alias("from_bare"))


@query
def url_parts(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("fetch_seq", "link", urls.url_parts("link").alias("p")).select(
        "fetch_seq", "link", "p.scheme", "p.netloc", "p.path", "p.params", "p.query", "p.fragment"
    )


@query
def link_absolute(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("fetch_seq", "href", urls.is_absolute("href").alias("absolute"))


@query
def link_resolve(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("fetch_seq", "parent_url", "href", "link")


@query
def host_parts(spark, sf_dir):
    split = hosts.split_host(inputs.link_parts(spark, sf_dir))
    return split.select("fetch_seq", "link", "host", "subdomain", "name", "suffix")


@query
def host_parts_by_rules(spark, sf_dir):
    """The same from a table of suffix rules, which here holds the last label of every host of the pages."""
    pages = _raw_pages(spark, sf_dir)
    last = F.substring_index(urls.url_host("url"), ".", -1)
    rules = pages.select(last.alias("suffix")).distinct().withColumn("kind", F.lit("normal"))
    split = hosts.with_host_parts(pages.withColumn("norm_url", urls.norm_url("url")), "norm_url", rules)
    return hosts.split_host(split).select("fetch_seq", "host", "subdomain", "name", "suffix", "site")


@query
def site_domain(spark, sf_dir):
    return _raw_pages(spark, sf_dir).select("fetch_seq", hosts.site_of("url").alias("site"))


@query
def tld_counts(spark, sf_dir):
    per_url = inputs.link_parts(spark, sf_dir).groupBy("suffix", "norm_url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("suffix").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_urls"))


@query
def url_root(spark, sf_dir):
    return _raw_pages(spark, sf_dir).select("fetch_seq", urls.root_url("url").alias("root"))


@query
def url_depth(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("fetch_seq", "link", urls.url_depth("link").alias("depth"))


@query
def link_validity(spark, sf_dir):
    checked = inputs.candidates(spark, sf_dir)
    return checked.select(
        "fetch_seq", "link", urls.link_problem("link", ("/the$", "utm_source", "[^a-z]$")).alias("problem")
    )


@query
def url_request_path(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("fetch_seq", "link", urls.request_path("link").alias("request_path"))


# Pages


@query
def status_actions(spark, sf_dir):
    pages = inputs.fetched(spark, sf_dir)
    acted = pages.select("status", content.status_action("status").alias("action"))
    return acted.groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))


@query
def content_filter(spark, sf_dir):
    kept = page_ops.accept_content(inputs.fetched(spark, sf_dir), CONFIG.accepted_content)
    return kept.select("fetch_seq", "content_type")


@query
def doc_encoding(spark, sf_dir):
    """Page texts as bytes in eight encodings, one of them not declared, brought back to text."""
    pages = _raw_pages(spark, sf_dir)
    kind, latin = F.col("fetch_seq") % 10, ~F.col("html").rlike("[^\\x00-\\xff]")
    cases = {
        0: ("ISO-8859-1", None), 1: ("ISO-8859-1", "Latin1"), 2: ("UTF-16LE", "utf-16le"), 3: ("UTF-16BE", "UTF-16BE"),
        4: ("UTF-32", "utf-32"), 5: ("ISO-8859-1", "cp1252"), 6: ("ISO-8859-1", "iso8859-15"), 7: ("ISO-8859-1", "windows-1254"),
    }
    body, declared = F.encode("html", "UTF-8"), F.lit(None).cast("string")
    for case, (charset, label) in cases.items():
        fits = (kind == case) & (latin if charset == "ISO-8859-1" else F.lit(True))
        body = F.when(fits, F.encode("html", charset)).otherwise(body)
        if label:
            declared = F.when(fits, F.lit(f"text/html; charset={label}")).otherwise(declared)
    stored = pages.withColumns({"body": body, "content_type": declared}).drop("html")
    back = page_ops.decode_body(stored)
    return back.select("fetch_seq", "encoding", F.md5("html").alias("html_md5"))


@query
def doc_charsets(spark, sf_dir):
    """Page texts in East Asian letters as bytes in five charsets of several bytes, declared in the header, brought back to text."""
    pages = _raw_pages(spark, sf_dir)
    plain = F.lower(F.regexp_replace("html", r"[^\x00-\x7f]", ""))
    body, declared = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for case, (_, label, charset, letters) in enumerate(inputs.CHARSETS):
        mine = F.col("fetch_seq") % len(inputs.CHARSETS) == case
        body = F.when(mine, F.encode(F.translate(plain, inputs.LATIN, letters), charset)).otherwise(body)
        declared = F.when(mine, F.lit(f"text/html; charset={label}")).otherwise(declared)
    back = page_ops.decode_body(pages.withColumns({"body": body, "content_type": declared}).drop("html"))
    return back.select("fetch_seq", "encoding", F.md5("html").alias("html_md5"))


@query
def link_extract(spark, sf_dir):
    return page_ops.extract_links(_raw_pages(spark, sf_dir))


@query
def link_distinct(spark, sf_dir):
    return page_ops.extract_links(_raw_pages(spark, sf_dir), distinct=True)


@query
def page_text(spark, sf_dir):
    text = _raw_pages(spark, sf_dir).select("fetch_seq", content.html_text("html").alias("text"))
    return text.select("fetch_seq", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def lang_profiles(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents")
    return language.train_profiles(documents, inputs.LANGS).select("lang", "word", "n", "place")


@query
def lang_scripts(spark, sf_dir):
    """Language of documents written over into other scripts, from profiles trained on these."""
    documents = inputs.other_scripts(spark, sf_dir)
    model = language.profile_words(language.train_profiles(documents, inputs.LANGS), inputs.LANGS)
    detected = language.with_language(documents, "text", model, "found")
    return detected.select("doc_id", "lang", "found", F.length("text").cast("bigint").alias("n_chars"))


@query
def lang_grams(spark, sf_dir):
    """Language of the whole documents by the likelihood of their character trigrams, from a model trained on them."""
    documents = inputs.table(spark, sf_dir, "documents")
    model = grams.gram_weights(grams.train_grams(documents, inputs.LANGS), inputs.LANGS)
    found = grams.with_gram_language(documents.select("doc_id", "text", F.col("lang").alias("label")), "text", model)
    return found.select("doc_id", "label", "lang", "lang_best", "lang_margin", "lang_grams")


@query
def lang_scores(spark, sf_dir):
    """Hits of each page in each language and the language picked from them, by joins with the profile table."""
    profiles = language.train_profiles(inputs.table(spark, sf_dir, "documents"), inputs.LANGS)
    pages = _raw_pages(spark, sf_dir)
    scores = language.score_language(language.page_words(pages), profiles, inputs.LANGS)
    picked = language.pick_language(scores, language.word_counts(pages))
    return picked.select("fetch_seq", F.col("n_words").cast("bigint").alias("n_words"), "best_lang", "best_hits", "second_hits", "lang")


@query
def page_lang(spark, sf_dir):
    """Language of each page as a map over the pages, with the profiles as a trained model."""
    detected = language.with_language(_raw_pages(spark, sf_dir), "html", inputs.model(spark, sf_dir))
    return detected.select("fetch_seq", "lang")


@query
def lang_labels(spark, sf_dir):
    """Labels as language models write them, brought to two letters."""
    three = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(
        F.col("lang") == "de", "deu"
    ).when(F.col("lang") == "es", "spa").otherwise("zzz")
    style = F.col("doc_id") % 5
    label = (
        F.when(style == 0, F.concat(F.lit("__label__"), three, F.lit("_Latn")))
        .when(style == 1, F.concat(F.lit("__label__"), three))
        .when(style == 2, F.col("lang"))
        .when(style == 3, F.concat(F.lit("__label__"), F.col("lang")))
        .otherwise(F.lit("__label__xyz"))
    )
    labelled = inputs.table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))
    return language.normalise_lang(labelled, "label").select("doc_id", "label", "lang")


@query
def kept_documents(spark, sf_dir):
    return inputs.kept(spark, sf_dir).select("fetch_seq", "norm_url", "site", "lang", "n_bytes")


@query
def page_outcomes(spark, sf_dir):
    judged = crawl.judge_pages(
        inputs.fetched(spark, sf_dir), CONFIG, inputs.model(spark, sf_dir), inputs.robots_files(spark, sf_dir)
    )
    return judged.groupBy("site", "outcome").agg(F.count(F.lit(1)).alias("n"))


# Links and frontier


@query
def link_blacklist(spark, sf_dir):
    kept = links.drop_blacklisted(inputs.link_parts(spark, sf_dir), CONFIG.url_blacklist)
    return kept.select("fetch_seq", "norm_url")


@query
def link_blacklist_table(spark, sf_dir):
    """Links without those that match a table of patterns: German sections under the first label of any host of the pages."""
    label = F.split_part("host", F.lit("."), F.lit(1))
    patterns = inputs.sited(spark, sf_dir).select(F.concat(F.lit("://"), label, F.lit(r"\.[^/]*/de/")).alias("pattern"))
    return links.drop_blacklisted(inputs.link_parts(spark, sf_dir), patterns).select("fetch_seq", "norm_url")


@query
def link_reasons(spark, sf_dir):
    """Links of every kind, made from the page URLs: each meets one of the reasons."""
    pages = inputs.sited(spark, sf_dir)
    number, own = F.col("fetch_seq"), F.col("norm_url")
    root = urls.root_url("norm_url")
    made = {
        0: F.lit("http://"), 1: F.concat(root, F.lit("/"), F.repeat(F.lit("x"), 3000)), 2: F.concat(F.lit("mailto:a@"), "host"),
        3: F.concat(F.lit("ftp://"), "host"), 4: F.concat(root, F.repeat(F.lit("/d"), 25)), 5: F.concat(root, F.lit("/spam-farm")),
        6: F.concat(F.lit("http://"), F.col("site"), F.lit(".zz/")), 7: F.concat(F.lit("http://other-"), F.col("site"), F.lit("/")),
    }
    link = own
    for case, value in made.items():
        link = F.when(number % 9 == case, value).otherwise(link)
    found = pages.select("fetch_seq", own.alias("parent_url"), F.col("site").alias("parent_site"), link.alias("link"))
    judged = links.admit_links(links.with_link_parts(found), CONFIG)
    return judged.select("fetch_seq", F.length("link").cast("bigint").alias("n_chars"), "reason")


@query
def link_classify(spark, sf_dir):
    classed = links.classify_links(inputs.link_parts(spark, sf_dir), ("com", "net"))
    return classed.select("fetch_seq", "parent_site", "norm_url", "site", "link_class")


@query
def link_admission(spark, sf_dir):
    return inputs.admission(spark, sf_dir).select("fetch_seq", "parent_url", "link", "reason")


@query
def frontier_new(spark, sf_dir):
    found = links.admitted(inputs.admission(spark, sf_dir))
    return frontier.new_links(found, inputs.visited(spark, sf_dir)).select("fetch_seq", "norm_url")


@query
def frontier_dedup(spark, sf_dir):
    found = frontier.dedup_links(links.admitted(inputs.admission(spark, sf_dir)))
    named = frontier.with_parent(found, page_ops.with_site(_raw_pages(spark, sf_dir)))
    return named.select("norm_url", "site", "first_seq", "parent_url", "n_found")


@query
def frontier_extend(spark, sf_dir):
    """Failed pages that may be fetched again, and the new links of all pages."""
    pages = inputs.sited(spark, sf_dir)
    again = pages.filter(content.status_action("status").isin("retry", "wait"))
    pending = again.select("norm_url", "site", F.col("fetch_seq").alias("added"))
    found = frontier.dedup_links(links.admitted(inputs.admission(spark, sf_dir)))
    new = frontier.new_links(found, inputs.visited(spark, sf_dir)).withColumn("added", F.col("first_seq"))
    return frontier.extend_frontier(pending, new)


@query
def redirect_links(spark, sf_dir):
    pages = page_ops.with_site(inputs.fetched(spark, sf_dir, with_location=True))
    found = links.admit_links(links.with_link_parts(links.redirect_links(pages)), CONFIG)
    return found.select("fetch_seq", "parent_url", "link", "site", "reason")


@query
def discovered_seeds(spark, sf_dir):
    return frontier.discovered_seeds(inputs.admission(spark, sf_dir)).select("site", "norm_url", "first_seq")


@query
def expand_sites(spark, sf_dir):
    """Seeds for sites of which one is running, one has stopped and the rest are new."""
    found = stage(frontier.discovered_seeds(inputs.admission(spark, sf_dir)), "seeds")
    # what is new: the sites of a part of the seeds under a name that no page has
    renamed = found.withColumn("site", F.when(F.col("first_seq") % 2 == 0, F.concat(F.lit("new-"), "site")).otherwise(F.col("site")))
    known = stage(inputs.sites(spark, sf_dir), "sites")
    return frontier.expand_sites(renamed, known).select("site", "n_seeds", "action", "priority")


@query
def next_urls(spark, sf_dir):
    """Five next URLs of each of the two sites first in line."""
    pages = inputs.sited(spark, sf_dir)
    waits = content.status_action("status") == "wait"
    pending = pages.select(
        "norm_url", "site", F.col("fetch_seq").alias("added"),
        F.when(waits, budgets.wait_until("fetch_ts", "retry_after")).alias("wait_until"),
    )
    served = frontier.served_sites(inputs.sites(spark, sf_dir), 2)
    now = F.lit(inputs.NOW).cast("timestamp_ntz")
    best = frontier.next_urls(pending, now, 5)
    return best.join(served.select("site", "priority"), "site").select("site", "priority", "place", "norm_url", "added")


def _page_graph(spark, sf_dir):
    """Links from page n to pages n + 1 and 2 n, on normalised URLs."""
    pages = _raw_pages(spark, sf_dir).select("fetch_seq", urls.norm_url("url").alias("url"))
    out = pages.select(
        F.col("url").alias("src"), F.explode(F.array(F.col("fetch_seq") + 1, F.col("fetch_seq") * 2)).alias("to_seq")
    )
    return out.join(pages.select(F.col("fetch_seq").alias("to_seq"), F.col("url").alias("dst")), "to_seq")


@query
def reachable_pages(spark, sf_dir):
    """URLs reachable from the first page of each site."""
    first = inputs.sited(spark, sf_dir).groupBy("site").agg(F.min_by("norm_url", "fetch_seq").alias("norm_url"))
    return reach.reachable(_page_graph(spark, sf_dir), first).select("norm_url")


# Robots


@query
def robots_policy(spark, sf_dir):
    return robots.robots_policy(inputs.robots_files(spark, sf_dir)).select("host", "policy")


@query
def robots_latest(spark, sf_dir):
    """Policy of hosts whose robots file was read twice, the first time with an error."""
    files = inputs.robots_files(spark, sf_dir)
    twice = files.withColumn("read_seq", F.lit(2)).unionByName(
        files.select("host", F.lit(500).alias("status"), F.lit("").alias("body"), F.lit(1).alias("read_seq"))
    )
    return robots.robots_policy(twice).select("host", "policy")


@query
def robots_allowed_any_case(spark, sf_dir):
    """Verdict on pages whose host is written in capitals, with the rules of the host in small letters."""
    raw = _raw_pages(spark, sf_dir)
    root = urls.root_url("url")
    capital = F.concat(F.lit("http://"), F.upper(urls.url_host("url")), F.substr("url", F.length(root) + 1))
    pages = page_ops.with_site(raw.withColumn("url", capital))
    lookup = robots.robots_lookup(inputs.robots_files(spark, sf_dir), CONFIG.user_agent)
    return robots.robots_allowed(pages, lookup).select("fetch_seq", "host", "allowed")


@query
def robots_rules(spark, sf_dir):
    return robots.robots_rules(inputs.robots_files(spark, sf_dir)).select(
        "host", F.col("group_no").cast("bigint").alias("group_no"), F.col("line_no").cast("bigint").alias("line_no"), "kind", "value"
    )


@query
def robots_allowed(spark, sf_dir):
    lookup = robots.robots_lookup(inputs.robots_files(spark, sf_dir), CONFIG.user_agent)
    return robots.robots_allowed(inputs.sited(spark, sf_dir), lookup).select("fetch_seq", "host", "allowed")


@query
def robots_delay(spark, sf_dir):
    return robots.robots_delay(robots.robots_rules(inputs.robots_files(spark, sf_dir)), CONFIG.user_agent)


@query
def site_delay(spark, sf_dir):
    return inputs.site_delays(spark, sf_dir)


# Scout


@query
def scout_steps(spark, sf_dir):
    steps = scout.scout_steps(inputs.kept(spark, sf_dir), CONFIG.scout_steps)
    return steps.select("site", F.col("step").cast("bigint").alias("step"), "fetch_seq", "lang")


@query
def lang_evidence(spark, sf_dir):
    return scout.lang_evidence(scout.scout_steps(inputs.kept(spark, sf_dir), CONFIG.scout_steps))


def _decisions(spark, sf_dir):
    return scout.scout_decision(scout.scout_steps(inputs.kept(spark, sf_dir), CONFIG.scout_steps), CONFIG)


@query
def scout_percent(spark, sf_dir):
    return _decisions(spark, sf_dir).select("site", scout.mandatory_percent(CONFIG).alias("percent"))


@query
def scout_decision(spark, sf_dir):
    return _decisions(spark, sf_dir).select(
        "site", "n_steps", "n_langs", "n_mandatory", "judged", "keep",
        F.coalesce("stop_seq", F.lit(-1).cast("bigint")).alias("stop_seq"),
    )


@query
def scout_apply(spark, sf_dir):
    """All pages, kept or not, up to the stop of their site."""
    pages = inputs.sited(spark, sf_dir).select("fetch_seq", "site", "norm_url")
    return scout.apply_stops(pages, _decisions(spark, sf_dir))


@query
def scout_policy(spark, sf_dir):
    """Verdicts of a policy over bytes and languages, on hosts taken as sites."""
    kept = inputs.kept(spark, sf_dir).select(F.col("host").alias("site"), "fetch_seq", "lang", "n_bytes")
    decided = scout.policy_decision(scout.measured(kept, inputs.POLICY), inputs.POLICY)
    return decided.withColumn("stop_seq", F.coalesce("stop_seq", F.lit(-1).cast("bigint")))


@query
def scout_links(spark, sf_dir):
    """Links of the pages up to the stop of their site, pages in other languages included."""
    arrays = page_ops.link_arrays(inputs.sited(spark, sf_dir).filter(crawl.eligible(CONFIG)))
    found = page_ops.explode_links(scout.apply_stops(arrays, _decisions(spark, sf_dir)))
    return found.select("fetch_seq", "parent_site", "link")


# Budgets


def _staged_kept(spark, sf_dir):
    """Kept documents without their text, detected once for all that look at them."""
    return stage(inputs.kept(spark, sf_dir).select("site", "fetch_seq", "lang", "n_bytes"), "kept")


@query
def size_budget(spark, sf_dir):
    return budgets.size_budget(_staged_kept(spark, sf_dir), inputs.SIZE_BUDGET_MB)


@query
def time_budget(spark, sf_dir):
    return budgets.time_budget(inputs.sited(spark, sf_dir), inputs.TIME_BUDGET_S)


@query
def exhausted_sites(spark, sf_dir):
    """Hosts, taken as sites, without a URL that may be fetched again."""
    pages = inputs.sited(spark, sf_dir).select(F.col("host").alias("site"), "status")
    again = pages.filter(content.status_action("status").isin("retry", "wait"))
    return budgets.exhausted_sites(pages.select("site").distinct(), again)


@query
def site_status(spark, sf_dir):
    pages = inputs.sited(spark, sf_dir)
    known = pages.groupBy("site").agg(F.max("fetch_seq").alias("last_seq"))
    again = pages.filter(content.status_action("status").isin("retry", "wait"))
    kept = _staged_kept(spark, sf_dir)
    status = budgets.site_status(
        known,
        scout.scout_decision(scout.scout_steps(kept, CONFIG.scout_steps), CONFIG).select("site", "stop_seq"),
        budgets.size_budget(kept, inputs.SIZE_BUDGET_MB),
        budgets.time_budget(pages, inputs.TIME_BUDGET_S),
        budgets.exhausted_sites(known, again),
    )
    return status.select("site", "cause", F.coalesce("stop_seq", F.lit(-1).cast("bigint")).alias("stop_seq"))


@query
def stop_causes(spark, sf_dir):
    """Sites, one for each host, that stop for every cause, some for two at once."""
    first = inputs.sited(spark, sf_dir).groupBy(F.col("host").alias("site")).agg(F.min("fetch_seq").alias("n"), F.max("fetch_seq").alias("last_seq"))
    first = stage(first, "hosts")
    at = {rest: first.filter(F.col("n") % 5 == rest).select("site", F.col("last_seq").alias("stop_seq")) for rest in range(3)}
    both = first.filter("n % 5 = 4").select("site", (F.col("last_seq") + 1).alias("stop_seq"))
    return budgets.site_status(
        first.select("site", "last_seq"), at[0].unionByName(both), at[0].unionByName(at[1]), at[2], first.filter("n % 5 = 4").select("site")
    )


@query
def attempt_state(spark, sf_dir):
    """One to seven failed attempts of each page, the second one final where there are two."""
    pages = _raw_pages(spark, sf_dir)
    last = F.col("fetch_seq") % 7 + 1
    attempts = F.explode(F.sequence(F.lit(1).cast("bigint"), last))
    log = pages.select(urls.norm_url("url").alias("norm_url"), last.alias("last"), attempts.alias("attempt")).withColumn(
        "action", F.when((F.col("attempt") == 2) & (F.col("last") == 2), "fail").otherwise("retry")
    )
    return budgets.attempt_state(log, CONFIG.max_attempts)


@query
def retry_wait(spark, sf_dir):
    waiting = budgets.retry_wait(inputs.fetched(spark, sf_dir))
    return waiting.select("fetch_seq", F.col("wait_until").cast("string").alias("wait_until"))


@query
def fetch_slots(spark, sf_dir):
    found = frontier.dedup_links(links.admitted(inputs.admission(spark, sf_dir)))
    new = frontier.new_links(found, inputs.visited(spark, sf_dir)).withColumn("added", F.col("first_seq"))
    new = stage(new.select("site", "norm_url", "added"), "frontier")
    start = F.lit(inputs.NOW).cast("timestamp_ntz")
    slots = budgets.fetch_slots(new, inputs.site_delays(spark, sf_dir), start)
    return slots.select("site", "norm_url", "slot", F.col("fetch_at").cast("string").alias("fetch_at"))


@query
def delay_audit(spark, sf_dir):
    return budgets.delay_audit(inputs.sited(spark, sf_dir), inputs.site_delays(spark, sf_dir))


@query
def site_report(spark, sf_dir):
    judged = crawl.judge_pages(inputs.fetched(spark, sf_dir), CONFIG, inputs.model(spark, sf_dir))
    return budgets.site_report(judged)


@query
def crawl_report(spark, sf_dir):
    """The whole run: what each site yields once it is stopped, and why it stopped."""
    pages = inputs.fetched(spark, sf_dir, with_location=True)
    done = crawl.run(pages, CONFIG, inputs.model(spark, sf_dir), inputs.robots_files(spark, sf_dir))
    report = budgets.site_report(done.judged.filter(~F.col("after_stop")))
    new = done.pending.groupBy("site").agg(F.count(F.lit(1)).alias("n_pending"))
    return (
        report.join(done.sites.select("site", "cause"), "site")
        .join(new, "site", "left")
        .select("site", "n_pages", "n_kept", "kept_bytes", "langs", "cause", F.coalesce("n_pending", F.lit(0).cast("bigint")).alias("n_pending"))
    )


@query
def crawl_documents(spark, sf_dir):
    """Documents of the whole run."""
    pages = inputs.fetched(spark, sf_dir, with_location=True)
    done = crawl.run(pages, CONFIG, inputs.model(spark, sf_dir), inputs.robots_files(spark, sf_dir))
    return done.documents.select("fetch_seq", "norm_url", "site", "encoding", "lang", F.md5("html").alias("html_md5"))


@query
def crawl_state(spark, sf_dir):
    """State that the whole run leaves to the next one; sites with their cause in the place of a URL."""
    pages = inputs.fetched(spark, sf_dir, with_location=True)
    done = crawl.run(pages, CONFIG, inputs.model(spark, sf_dir), inputs.robots_files(spark, sf_dir))
    tables = crawl.next_state(done, CONFIG)
    parts = {
        "attempts": tables["attempts"],
        "visited": tables["visited"].withColumn("n", F.lit(0).cast("bigint")),
        "pending": tables["pending"].select("site", "norm_url", F.col("added").alias("n")),
        "sites": tables["sites"].select("site", F.col("cause").alias("norm_url"), F.col("priority").alias("n")),
    }
    out = [rows.select(F.lit(name).alias("state"), "site", "norm_url", "n") for name, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# Streams


@query
def stream_links(spark, sf_dir):
    """Admitted URLs of the pages read as a stream."""
    schema = inputs.table(spark, sf_dir, "pages").schema
    pages = as_pages(stream_table(spark, sf_dir, "pages", schema))
    path, checkpoint = new_path(spark, "frontier"), new_path(spark, "frontier_checkpoint")
    write_frontier(stream_frontier(pages, CONFIG), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("norm_url", "site")


def _kept_stream(spark, sf_dir):
    """Kept documents written as a run and read as a stream."""
    path = new_path(spark, "kept")
    narrow = inputs.kept(spark, sf_dir).select("site", "lang", "fetch_seq", "norm_url")
    narrow.write.parquet(path)
    return stream_parquet(spark, path, narrow.schema)


@query
def stream_scouted(spark, sf_dir):
    """Kept documents that pass the scout, read as a stream."""
    path, kept_state = new_path(spark, "scouted"), new_path(spark, "scout_state")
    stream_scout(_kept_stream(spark, sf_dir), CONFIG, path, kept_state).awaitTermination()
    return read_scouted(spark, path).select("site", "lang", "fetch_seq", "norm_url")


@query
def stream_policy(spark, sf_dir):
    """Documents that pass a policy over bytes and languages, on hosts taken as sites, read as a stream of several batches in the order of fetching."""
    path, kept_state, source = new_path(spark, "scouted"), new_path(spark, "scout_state"), new_path(spark, "kept")
    kept = inputs.kept(spark, sf_dir).select(F.col("host").alias("site"), "lang", "fetch_seq", "n_bytes")
    kept = stage(kept, "kept")
    bounds = kept.agg(F.min("fetch_seq"), F.max("fetch_seq")).first()
    # pages arrive in four parts, one after the other
    for part in range(4):
        low, high = (bounds[0] + (bounds[1] + 1 - bounds[0]) * i // 4 for i in (part, part + 1))
        kept.filter((F.col("fetch_seq") >= low) & (F.col("fetch_seq") < high)).write.parquet(f"{source}/part={part}")
        arrived = stream_parquet(spark, f"{source}/*", kept.schema)
        stream_scout(arrived, CONFIG, path, kept_state, inputs.POLICY).awaitTermination()
    return read_scouted(spark, path).select("site", "lang", "fetch_seq", "n_bytes")


@query
def stream_lang_evidence(spark, sf_dir):
    """Running counts of kept documents per site and language after the stream has been read."""
    path, checkpoint = new_path(spark, "evidence"), new_path(spark, "evidence_checkpoint")
    write_evidence(stream_evidence(_kept_stream(spark, sf_dir)), path, checkpoint).awaitTermination()
    return read_evidence(spark, path).select("site", "lang", "n")
