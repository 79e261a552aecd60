"""The reachable set against breadth-first search: chains, rings, hubs, bounds, and what a round reads."""

import random

import pytest

from sitesieve.operators import reach


def search(edges, seeds, most=None):
    out = {}
    for s, t in edges:
        if s != t:
            out.setdefault(s, set()).add(t)
    hops, here = {s: 0 for s in seeds}, list(seeds)
    while here:
        here = [t for s in here for t in out.get(s, ()) if hops[s] + 1 < hops.get(t, 1 << 60) and not hops.__setitem__(t, hops[s] + 1)]
    return {u: h for u, h in hops.items() if most is None or h <= most}


def run(spark, edges, seeds, most=None):
    links = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    got = reach.reachable(links, spark.createDataFrame([(s,) for s in seeds], "norm_url string"), most).collect()
    assert len(got) == len({r.norm_url for r in got})
    return {r.norm_url: r.hops for r in got}


@pytest.mark.parametrize("seed,most", [(1, None), (2, 4)])
def test_random_graphs(spark, seed, most):
    random.seed(seed)
    edges = [(f"n{random.randrange(80)}", f"n{random.randrange(80)}") for _ in range(90)]
    # chains that leave and enter the rest, a ring with and one without an entrance, a hub, repeated links
    edges += [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("n1", "c0"), ("c30", "n2"), ("n3", "c31"), ("c31", "c32"), ("c32", "n3")]
    edges += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("q1", "q2"), ("q2", "q1"), ("n4", "q1")] + [("hub", f"h{i}") for i in range(50)] + edges[:20] + [("n5", "hub")]
    seeds = ["n0", "n1", "n3", "n5", "c10", "nowhere"]
    assert run(spark, edges, seeds, most) == search(edges, seeds, most)


def test_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    counts, staged = [], []
    write, stage = reach._write_counted, reach.stage
    monkeypatch.setattr(reach, "_write_counted", lambda df, path: counts.append(write(df, path)) or counts[-1])
    monkeypatch.setattr(reach, "stage", lambda df, name: staged.append(name) or stage(df, name))
    edges = [(f"u{i}", f"u{i + 1}") for i in range(1000)]
    assert run(spark, edges, ["u0"]) == {f"u{i}": i for i in range(1001)}
    assert len(counts) == 3 and staged.count("chains") <= 13


def test_rounds_open_only_the_folders_of_new_urls(spark, monkeypatch):
    opened = []
    parts = reach._parts_of
    monkeypatch.setattr(reach, "_parts_of", lambda df: opened.append(parts(df)) or opened[-1])
    random.seed(5)
    edges = [(f"a{i}", f"b{random.randrange(3000)}") for i in range(3000)] + [("s", "t"), ("s", "a1"), ("t", "a1"), ("t", "a2"), ("a1", "a2")]
    assert run(spark, edges, ["s"]) == search(edges, ["s"])
    assert all(len(found) <= 4 for found in opened)


def test_nothing_to_reach(spark):
    assert run(spark, [], ["a"]) == {"a": 0}
    assert run(spark, [("a", "b")], []) == {}
    assert run(spark, [("a", "a"), (None, "b"), ("b", None)], ["a"]) == {"a": 0}
