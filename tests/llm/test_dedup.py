"""Exact and near duplicates against plain loops, on copies, near copies, nulls, ties and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitesieve.llm import exact_dedup, simhash_dedup
from sitesieve.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int"


def frame(spark, rows):
    """Documents from (id, text), with extra columns named like inner ones."""
    return spark.createDataFrame([(i, t, "en", None, None, "k", 3) for i, t in rows], SCHEMA).repartition(3)


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, " a b c"), (4, None), (7, ""), (8, "  "), (1, "x" * 70_000), (2, "x" * 70_000), (None, "a b c"),
    (None, "only nulls"), (None, "only nulls"), (3, "a b c"), (11, "é é"), (12, "é é"), (3, "other text"), (6, "other text"),
]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    expected = []
    for i, t in ROWS:
        members = groups[norm(t)]
        least = min((m for m in members if m is not None), default=None)
        expected.append((str(i), str(least), len(members), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in got) == sorted(expected)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_drop_keeps_one_of_each(spark):
    docs = frame(spark, ROWS)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(norm(r.text) for r in rows) == sorted({norm(t) for _, t in ROWS})
    assert {r.doc_id for r in rows if norm(r.text) == "a b c"} == {3}
    assert {r.doc_id for r in rows if r.text == "other text"} == {3}


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []
    assert exact_dedup.drop_duplicates(frame(spark, [])).collect() == []


def test_merge_tree_of_a_hot_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(docs.repartition(16)).groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias("size"), F.sum(F.col("kept").cast("int")).alias("kept"))
    hot = got.filter("keep_id = 0").first()
    assert (hot.n, hot["size"], hot.kept) == (1334, 1334, 1)
    assert got.filter("kept <> 1").isEmpty()


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "  ", "One", "Two words", "É ñ Ü x Y z", "a b c a b c a b c " * 50, "w " * 200_000])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text, 3) & (1 << 64) - 1 == plain_fingerprint(text)


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    rows, i = [(100 + k, t) for k, t in enumerate([None, "", "one", "ONE", "one two", "one two"])], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 150, 400]))]
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 - i, " ".join(copy)))
            i += 1
    return rows


def test_near_groups(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in simhash_dedup.near_groups(frame(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = union_find(near, prints)
    assert len(set(expected.values())) < len(rows) - 20
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == expected


def test_near_drop(spark):
    rows = near_rows(2) + [(500, "the same text here"), (500, "the same text here"), (500, "quite another one"), (None, "no id"), (None, "no id")]
    docs = frame(spark, rows)
    left = simhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in left.collect()]
    assert len(texts) == len(set(texts))
    assert len({simhash_dedup.fingerprint(t, 3) for _, t in texts}) == len(texts)
    groups = simhash_dedup.near_groups(docs).select("component_id").distinct().count()
    assert {i for i, _ in texts} == {r.component_id for r in simhash_dedup.near_groups(docs).collect()}
    assert len(texts) == groups + 1  # id 500 stands for two groups
    assert simhash_dedup.drop_near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("bits", [0, 2, 3, 5])
def test_links_connect_what_is_near(spark, bits):
    rng = np.random.default_rng(bits)
    fps = list(rng.integers(0, 1 << 63, 40, dtype=np.int64))
    for _ in range(260):
        fp = int(fps[rng.integers(len(fps))])
        for b in rng.integers(0, 63, rng.integers(1, bits + 2)):
            fp ^= 1 << int(b)
        fps.append(fp)
    fps = sorted({int(x) for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = [(r.u, r.v) for r in simhash_dedup.links(df, bits).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in found)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    assert union_find(found, fps) == union_find(near, fps)


def test_a_family_of_near_copies_gives_few_links():
    rng = np.random.default_rng(0)
    fps = np.unique(np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (3000, 2))], dtype=np.uint64))
    found = simhash_dedup.cell_links(fps, np.ones(len(fps), bool), 4)
    assert len(found) == len(fps) - 1


def test_components_of_chain_star_and_ties(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (3, 2), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
