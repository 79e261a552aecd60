"""The pipeline stage by stage against plain loops, on the smallest documents and some odd rows."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import norm, plain_fingerprint, union_find
from test_mix_decontaminate import plain_contamination, plain_targets

from sitesieve.llm import quality
from sitesieve.llm.common import DOCUMENT_COLUMNS
from sitesieve.session import stage

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    odd = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, passage + " " + passage, "en", None, 9), (9004, "Plain words. They end here.", None, None, 5)]
    odd += [(9005, "Plain  words. They end here.", "en", "src1", 1), (9006, "Other words stand here. They end as well.", "en", "src1", 1)] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before = docs.collect()
    after = {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, DATA), "out")
        rows = out.collect()
        after[name] = (before, rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        docs, before = out, rows
    assert [n for n, _ in corpus_pipeline.STAGES] == list(after)

    given, kept = after["quality classifier"]
    judged = quality.judge(spark.createDataFrame(given, docs.schema)).filter("kept").collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in judged)
    assert {9001, 9002}.isdisjoint(r.doc_id for r in kept) and 9006 in {r.doc_id for r in kept}

    given, kept = after["exact dedup"]
    least = {}
    for r in given:
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept) == sorted(least.values())

    given, kept = after["simhash near-dedup"]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in given}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert sorted(r.doc_id for r in kept) == sorted(set(union_find(near, prints).values()))

    given, kept = after["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [i for i, _, hit, _ in plain_contamination([(r.doc_id, r.text) for r in given], items) if not hit]
    assert sorted(r.doc_id for r in kept) == sorted(clean) and 9003 not in clean and len(clean) < len(given)

    given, mixed = after["mixing sources"]
    size = {r.doc_id: len(r.text.split()) for r in given}
    total, taken, largest = Counter(), Counter(), Counter()
    for r in given:
        total[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert {r.doc_id for r in mixed} <= set(size) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    for source, target in plain_targets(total).items():
        assert abs(taken[source] - target) <= max(1, largest[source] / 2)


def test_run_is_the_stages_in_turn(spark):
    whole = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, DATA), "out")
    key = [F.col("doc_id"), F.md5("text").alias("text")]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, DATA), "out")
    assert docs.count() == 0
