"""Character-gram language model."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sitesieve.operators import grams, language

LANGS = ["de", "en", "es", "fr"]


def plain_bins(text):
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    codes = [ord(c) for c in f" {letters} "]
    return [(a * 961 + b * 31 + c) % grams.BINS for a, b, c in zip(codes, codes[1:], codes[2:])]


def test_bins(spark):
    texts = [None, "", " 1 2 ", "a", "Ab  c-d", "été 日本語", "\U00010400x", "x" * 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", grams.bins("t").alias("b"))
    assert {r.i: list(r.b) for r in rows.collect()} == {i: plain_bins(t) if plain_bins(t) and t not in (None, "", " 1 2 ") else [] for i, t in enumerate(texts)}


def test_scores_against_a_plain_loop(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["en", "fr", "xx"]), " ".join(rng.choice(["the", "le", "un", "été", "of"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(100, "en", None), (101, None, "the")]
    df = spark.createDataFrame(docs, "i int, label string, text string")
    model = grams.gram_weights(grams.train_grams(df, ["en", "fr"], lang="label"), ["en", "fr"])
    counts = {code: Counter(b for _, label, text in docs if label == code for b in plain_bins(text) if text) for code in ("en", "fr")}
    got = {r.i: r for r in grams.with_gram_language(df, "text", model).collect()}
    assert len(got) == len(docs)
    for i, _, text in docs:
        found = plain_bins(text) if text else []
        scores = sorted((-sum(round(1000 * math.log((c[b] + 1) / (sum(c.values()) + grams.BINS))) for b in found), code) for code, c in counts.items())
        lead = scores[1][0] - scores[0][0]
        expected = (scores[0][1] if found and lead >= grams.MARGIN else None, scores[0][1] if found else None, lead, len(found))
        assert (got[i].lang, got[i].lang_best, got[i].lang_margin, got[i].lang_grams) == expected


def test_empty_table_one_language_and_parts(spark):
    df = spark.createDataFrame([(1, "en", "the cat"), (2, "en", "a dog")], "i int, lang string, text string")
    parts = grams.train_grams(df.filter("i = 1"), ["en"]).unionByName(grams.train_grams(df.filter("i = 2"), ["en"]))
    assert grams.gram_weights(parts, ["en"]) == (model := grams.gram_weights(grams.train_grams(df, ["en"]), ["en"]))
    assert [(r.found, r.found_best, r.found_margin) for r in grams.with_gram_language(df, "text", model, "found").collect()] == [(None, "en", 0)] * 2
    assert grams.with_gram_language(df.limit(0), "text", model, "found").collect() == []
    assert grams.gram_weights(grams.train_grams(df.limit(0), LANGS), LANGS) == {}


def test_short_texts_at_least_as_well_as_words(spark):
    """Models from one half of the documents, on the first 40 characters of the other half."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*LANGS) & (F.length("text") > 200))
    first, second = documents.filter("doc_id % 2 = 0"), documents.filter("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth"), F.substring("text", 1, 40).alias("text"))
    by_words = language.with_language(second, "text", language.profile_words(language.train_profiles(first, LANGS), LANGS), "found")
    by_grams = grams.with_gram_language(second, "text", grams.gram_weights(grams.train_grams(first, LANGS), LANGS), "found")
    right = [df.filter("found = truth").count() for df in (by_words, by_grams)]
    wrong = [df.filter("found <> truth").count() for df in (by_words, by_grams)]
    print(second.count(), right, wrong)
    assert right[1] >= right[0] and wrong[1] <= 0.05 * second.count()


def test_training_shuffles_bins_and_no_python(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = grams.train_grams(documents, LANGS)
    plan = grams.with_gram_language(documents, "text", grams.gram_weights(counts, LANGS), "found")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
