"""Quality, licence scan and line dedup: held-out labels, brute force, and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesieve.llm import license_scan, line_dedup, quality, queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, line string, score double, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "k", "l", 0.5, 1) for i, t in rows], SCHEMA).repartition(3)


def test_quality_against_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))
    by = {r.quality: (r.n, r.kept) for r in got.collect()}
    assert by[1][0] == by[1][1] > 300
    assert by[0][1] <= 0.02 * by[0][0]


def test_quality_of_odd_rows(spark):
    good = "The quick brown fox met a lazy dog near the old mill. It was late, and nobody saw them leave. "
    rows = [(i, good * (1 + i % 3)) for i in range(40)] + [(100 + i, "BUY!! NOW!! WOW!! " * 20) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, good * 3000), (203, good * 3000), (None, good), (204, "x"), (205, "Это хороший текст. Он о погоде, и он длинный. " * 3)]
    docs = frame(spark, rows)
    got = {(r.doc_id, i): r.kept for i, r in enumerate(quality.judge(docs).collect())}
    assert len(got) == len(rows)
    kept = {k for (k, _), v in got.items() if v}
    assert kept >= {*range(40), 203, None, 205}
    assert not kept & {*range(100, 110), 200, 201, 202}
    left = quality.drop_poor(docs)
    assert left.columns == docs.columns and left.count() == sum(got.values())
    assert quality.judge(frame(spark, [])).collect() == []
    assert [r.kept for r in quality.judge(frame(spark, [(1, None)])).collect()] == [False]


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth, accuracy = rng.random(20_000) < 0.8, np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    right = rng.random((truth.size, 5)) < accuracy
    spoken = rng.random((truth.size, 5)) < 0.8
    said = np.where(spoken, np.where(right == truth[:, None], quality.GOOD, quality.BAD), quality.ABSTAIN)
    patterns, which, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    found, share, post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.04
    assert abs(share - 0.8) < 0.05
    assert ((post > 0.5)[which.ravel()] == truth).mean() > 0.93


def test_same_model_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = quality.fit(docs.repartition(5)), quality.fit(docs.coalesce(1))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_scan_finds_every_template_and_its_edits(spark):
    names, rows = [], []
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        names.append(name)
        rows.append((10 * i, f"Some words before.\n{text.upper()}\nand after"))
        if len(words) >= 12:
            edited = words[: len(words) // 2] + ["inserted"] + words[len(words) // 2 + 1 :]
            rows.append((10 * i + 1, "x " * 20_000 + " ".join(edited)))
    rows += [(-1, None), (-2, ""), (-3, "license the under and"), (None, rows[0][1]), (None, rows[0][1])]
    got = license_scan.scan(frame(spark, rows)).collect()
    texts = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        if r.doc_id is not None:
            span = texts[r.doc_id][r.start : r.stop]
            assert re.sub(r"\W", "", span)[:3].lower() in re.sub(r"\W", "", dict(license_scan.TEMPLATES)[r.license_id]).lower()
    for i, name in enumerate(names):
        assert [r.license_id for r in by[10 * i]] == [name] and by[10 * i][0].coverage == 1.0
    assert all(0.8 <= r.coverage < 1 for k, rs in by.items() if k is not None and k % 10 == 1 for r in rs)
    assert {k for k in by if k is not None and k % 10 == 1} == {i for i, _ in rows if i is not None and i % 10 == 1}
    assert len(by[None]) == 2 and not {-1, -2, -3} & set(by)
    assert license_scan.scan(frame(spark, [])).collect() == []


def test_template_cut_off_at_the_start_of_a_text():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        if len(words) < 12:
            continue
        for cut in (1, 2):
            rest = " ".join(words[cut:])
            found = [f for f in index.scan(rest + " and so on", 0.8) if f[0] == name]
            m = len(license_scan.words_of(text))
            left = len(license_scan.words_of(rest))
            assert [(f[3], f[4]) for f in found] == [(left, left / m)]
            assert license_scan.words_of(rest) == license_scan.words_of((rest + " and so on")[found[0][1] : found[0][2]])


def test_winnowing_leaves_an_entry_in_every_window():
    rng = random.Random(3)
    for n in range(1, 40):
        hashes = [rng.randrange(6) for _ in range(n)]
        kept = license_scan.winnow(hashes, 4)
        assert all(any(s <= k < s + 4 for k in kept) for s in range(max(1, n - 3)))


def test_alignment_measures_gaps():
    t = "a b c d e f g h i j".split()
    assert license_scan.align(t, t, 0, 3) == (10, 0, 9)
    assert license_scan.align(t, "x a b c y d e f g h i j".split(), 1, 3)[0] == 10
    assert license_scan.align(t, "a b d e f g h i j".split(), 0, 3)[0] == 9
    with pytest.raises(ValueError):
        license_scan.Index([("big", "x" * (license_scan.MOST_TEMPLATE_BYTES + 1))])


def within_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for place, line in enumerate((text or "").split("\n")):
            words = tuple(re.findall("[^\x20\x09-\x0d]+", line))
            if words:
                if any(within_one(words, o) for o in seen):
                    gone.append(place)
                seen.append(words)
        out[i] = gone
    return out


def line_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 9, 10, 11, 25]))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], "new"]])
                w = w or ["w0"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((500 - i, "\n".join(lines)))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "long " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rows_to_broadcast", [0, 500_000])
def test_lines(spark, monkeypatch, seed, rows_to_broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows_to_broadcast)
    rows = line_rows(seed)
    got = {r.doc_id: r for r in line_dedup.dropped_lines(frame(spark, rows)).collect()}
    expected = plain_lines(rows)
    assert {i: r.dropped for i, r in got.items()} == expected
    assert got[1000].n_lines == got[1002].n_lines == 0


def test_lines_of_template_family_stay_linear(spark):
    text = lambda i: f"page {i} of the long report on the state of the forests in the north was printed in june"
    rows = [(i, text(i)) for i in range(400)] + [(None, text(5)), (None, text(5))]
    docs = frame(spark, rows)
    got = line_dedup.dropped_lines(docs)
    assert got.filter("n_dropped = 0").select("doc_id").collect() == [(0,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert left.filter("text <> ''").count() == 1
    assert line_dedup.dropped_lines(frame(spark, [])).collect() == []


def test_short_lines_stay_unless_equal(spark, tmp_path):
    five = "these five words stand here"
    rows = [(1, f"Intro\nMethods\nfirst part\n{five}"), (2, "Results\nfirst step\nfirst\none two three four"), (3, "one two three five\n Intro \none two three four five")]
    rows += [(4, f"these five words stay here\n{five} now\nfirst  part\nthese five words stand")]
    docs = frame(spark, rows)
    gone = {1: [], 2: [], 3: [1], 4: [0, 1, 2]}
    assert {r.doc_id: r.dropped for r in line_dedup.dropped_lines(docs, line_dedup.LEAST).collect()} == gone
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == kept
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.dropped_lines for r in asked} == {i: ",".join(map(str, g)) for i, g in gone.items()}
