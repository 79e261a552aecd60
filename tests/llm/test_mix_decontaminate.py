"""Mixing and decontamination: invariants and brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitesieve.llm import decontaminate, mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "k", 1, "s") for i, t, s in rows], SCHEMA).repartition(3)


def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    done = {}
    while True:
        left = share * sum(sizes.values()) - sum(done.values())
        others = [s for s in order if s not in done]
        fair = {s: left * weight[s] / sum(weight[o] for o in others) for s in others}
        over = [s for s in others if fair[s] > most * sizes[s]]
        if not over:
            return done | fair
        done |= {s: most * sizes[s] for s in over}


def mix_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "é", "Z", None, "c"])
        words = rng.choice([0, 1, 5, 30, 60, 60, 80, 400])
        rows.append((i, rng.choice([" ", "\t\n", "  "]).join(["w%d" % rng.randrange(9)] * words), source))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 12), (2, 300), (3, 2500)])
def test_mix(spark, seed, n):
    rows = mix_rows(seed, n) + [(10**6, None, "a"), (None, "x y z", "b"), (None, "x y z", "b"), (7, "same row", "c"), (7, "same row", "c")]
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    docs = frame(spark, rows)
    got = mix.mixed(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        base = int(r.target / r.source_size + 1e-9) if r.source_size else 0
        assert r.copies in (base, base + 1) and r.copies <= 2 or r["size"] == 0 == r.copies
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(1, largest[s] / 2)
    again = mix.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_are_repeated(spark):
    docs = frame(spark, mix_rows(4, 200) + [(7, "same row", "c")] * 2)
    out = mix.mix(docs)
    assert out.columns == docs.columns
    expected = Counter()
    for r in mix.mixed(docs).collect():
        expected[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +expected
    assert mix.mix(frame(spark, [])).collect() == []
    assert mix.mixed(frame(spark, [(1, None, None), (2, "", "a")])).agg(F.sum("copies")).first()[0] == 0


def test_no_source_is_systematically_short_of_copies(spark):
    rows = [(i, "w " * 10, "a") for i in range(900)] + [(1000 + i, "w " * 10, "b") for i in range(1800)] + [(9000 + i, "w", "c") for i in range(10)]
    by = mix.mixed(frame(spark, rows)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    for r in by.collect():
        assert abs(r.taken - r.target) <= 10


@pytest.mark.parametrize("small", [100, 300])
def test_a_dominant_document_is_made_up_for_beside_a_large_source(spark, small):
    rows = [(i, "w " * 200, "a") for i in range(small)] + [(10_000, "w " * 20_000, "a")] + [(20_000 + i, "w " * 300, "b") for i in range(1200)]
    by = {r.source: r for r in mix.mixed(frame(spark, rows), (1, 8), 0.5).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}
    for s, words in (("a", 200), ("b", 300)):
        assert 0 < by[s].target and abs(by[s].taken - by[s].target) <= words


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items):
    out = []
    for i, text, *_ in docs:
        words, hit, found = words_of(text), set(), set()
        for item, of in items:
            w = words_of(of)
            n = min(10, len(w))
            for s in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(words), len(hit), ",".join(sorted(found))))
    return out


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "É", "É", "ÉTÉ", "été", "x1", "Y", "straße", "ΣΑΣ", "σας"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for k in range(14)] + [(90, None), (91, ""), (92, "?!"), (93, "the of"), (94, "The, OF")]
    long = items[5][1]
    rows = [(k, text(rng.choice([0, 1, 5, 60])), None) for k in range(40)]
    rows += [(50, None, None), (51, "a " + long + " b " + long.upper(), None), (None, long, None), (None, long, None), (52, "the of", None), (52, "other", None), (52, "the of", None)]
    rows.append((60, "fill " * 30_000 + long, None))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    import hashlib

    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    expected = plain_contamination(rows, items)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated)) for r in got) == sorted(
        str((i, n, h, hashlib.sha256(f.encode()).hexdigest(), h > 0)) for i, n, h, f in expected
    )
    assert sorted(r.n_items for r in got) == sorted(len(f.split(",")) if f else 0 for *_, f in expected)
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str((i, t)) for (i, t, _), e in zip(rows, expected) if not e[2])


def test_blocks_of_windows_give_the_same(spark, monkeypatch):
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve", None), (2, "nothing here", None)]
    bench = spark.createDataFrame([(1, rows[0][1]), (2, "nothing")], "item_id long, text string")
    whole = decontaminate.contamination(frame(spark, rows), bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    assert decontaminate.contamination(frame(spark, rows), bench).orderBy("doc_id").collect() == whole
    assert [r.n_hit for r in whole] == [12, 1]


def test_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, [(1, "a b", None)]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), some).collect() == []


def test_native_plans(spark):
    docs = frame(spark, mix_rows(1, 20))
    bench = spark.createDataFrame([(1, "w1 w1 w1")], "item_id long, text string")
    for df in (mix.mixed(docs), mix.mix(docs), decontaminate.contamination(docs, bench), decontaminate.drop_contaminated(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
