"""The trie of conversations against a plain loop over all prefixes, with levels, shards, copies and empty ones."""

import hashlib
import random
import zlib

import pytest

from sitesieve.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id long, digest string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for prefix, convs_here in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = {p for p in below if len(p) == len(prefix) + 1}
        ends = sorted(c for c in convs_here if len(convs[c]) == len(prefix))
        out.add((
            min(convs_here), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs_here), len(children),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def made(seed, n=60):
    random.seed(seed)
    rows, texts = [], ["", "a", "é\U0001f600", "long " * 50, None, "b"]
    for c in random.sample(range(-20, 330), n):
        for turn in range(random.choice((1, 2, 3, 9))):
            rows.append((c, turn, random.choice(("user", None)), random.choice(texts[: random.choice((1, 2, 6))])))
    for c in range(400, 425):  # a large group of copies, and of copies that go on
        rows += [(c, t, "user", "same") for t in range(8 + (c > 418))]
    return rows


@pytest.mark.parametrize("segment,shard", [(128, 1 << 16), (2, 7), (3, 1)])
def test_trie_equals_brute_force(spark, segment, shard):
    rows = made(segment)
    got = prefix_trie.conversation_trie(frame(spark, rows), segment, shard).collect()
    expected = brute(ordered(rows))
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("segment,shard", [(128, 1 << 16), (2, 5)])
def test_rebuilt_conversations(spark, segment, shard):
    rows = made(7)
    rows += [(100, None, "system", "null turn first"), (100, 3, None, None), (100, 3, None, None), (None, 1, "user", "of no conversation")]
    rows += [(505, 0, "user", "loses its only turn")]
    convs = rebuilt(ordered(rows))
    assert any(not seq for seq in convs.values())
    got = prefix_trie.nodes(*prefix_trie.with_shared_heads(prefix_trie.turns(frame(spark, rows))), segment, shard).collect()
    expected = brute(convs)
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(700 if c < 3 else 300)] + [(2, 700, "user", "x" * 300_000)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.conversation_trie(frame(spark, rows)).collect()}
    assert len(got) == 702
    total = sum((3 if t < 300 else 2) * len(f"t{t}") - len(f"t{t}") for t in range(700))
    assert got[1, 0].saved_tokens == total and got[1, 0].n_convs == 3 and got[1, 0].n_leaves == 1
    assert got[1, 700].n_children == 1 and got[2, 701].n_leaves == 1 and got[2, 701].parent_conv_id == 1


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0
    assert prefix_trie.nodes(*prefix_trie.with_shared_heads(prefix_trie.turns(frame(spark, [(None, 1, "user", "x")])))).count() == 0
