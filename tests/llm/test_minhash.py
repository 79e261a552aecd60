"""Near copies by MinHash against all pairs of full sets, with long lists, several tiles, copies, nulls and repeated rows."""

import random

import numpy as np
import pytest

from sitesieve.llm import minhash_dedup

SCHEMA = "doc_id long, text string, sid long, key string, part int, root int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows], SCHEMA).repartition(4)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(str((i, len(s), c := least.get(g) if s else i, i == c)) for g, (i, _), s in zip(group, rows, sets))


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.random()}"
    return words


def made(seed):
    random.seed(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "two one"), (None, "one"), (None, "alone and null")]
    rows += [(1003, "one"), (1007, "x " * 9), (1008, "X " * 400), (1009, "é Ü ß"), (1010, "É ü ß")]
    numbers = random.sample(range(900), 400)
    for _ in range(6):
        base = [f"w{random.randrange(500)}" for _ in range(random.choice((20, 80, 300)))]
        for _ in range(random.choice((3, 30))):
            rows.append((numbers.pop(), " ".join(edited(base, random.choice((0, 1, 1, 2, 3, len(base) // 40, len(base) // 12))))))
    # a chain of texts of which only neighbours are near, and many that share a passage but little else
    chain = [f"c{i}" for i in range(300)]
    rows += [(numbers.pop(), " ".join(chain[i * 15 : i * 15 + 210])) for i in range(6)]
    passage = [f"p{i}" for i in range(120)]
    rows += [(numbers.pop(), " ".join(passage + [f"q{random.random()}" for _ in range(random.choice((5, 30, 60)))])) for _ in range(25)]
    return rows


@pytest.mark.parametrize("longest,tile", [(minhash_dedup.LIST, minhash_dedup.TILE), (4, 2_000)])
def test_groups_equal_all_pairs(spark, longest, tile):
    rows = made(longest)
    got = minhash_dedup.near_groups(frame(spark, rows), longest=longest, tile=tile).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_long_text_and_empty_table(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(5, " ".join(words)), (4, " ".join(words[:190_000])), (3, " ".join(words[100_000:]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(frame(spark, rows)).collect()}
    assert got == {5: (199_998, 4, False), 4: (189_998, 4, True), 3: (99_998, 3, True)}
    assert minhash_dedup.near_groups(frame(spark, [])).count() == 0


def test_matches_estimate_similarity():
    rng = np.random.default_rng(3)
    lost, share = 0, []
    for _ in range(400):
        both = rng.integers(0, 1 << 64, 185, dtype=np.uint64)
        a, b = both[:170], np.concatenate([both[:157], both[170:]])  # 157 of 183: 85.8 %
        same = (minhash_dedup.signature(np.sort(a)) == minhash_dedup.signature(np.sort(b))).sum()
        lost += same < minhash_dedup.MATCHES
        share.append(same / minhash_dedup.COORDINATES)
    assert lost == 0 and abs(np.mean(share) - 157 / 185) < 0.01


def test_shingles_longer_than_the_table_of_factors():
    cache = {}
    a = minhash_dedup.shingle_set(" ".join(map(str, range(200))), 100, cache)
    b = minhash_dedup.shingle_set(" ".join(map(str, [*range(70), 999, *range(71, 200)])), 100, cache)
    assert len(a) == len(b) == 101 and len(np.intersect1d(a, b)) == 30 and len(np.unique(a)) == 101


def test_counting_a_whole_tile_equals_one_by_one():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300), dtype=np.uint64)) for _ in range(40)]
    postings = minhash_dedup._Postings(sets)
    for i in range(len(sets)):
        common = postings.common(i)
        own = [len(np.intersect1d(sets[i], s)) for s in sets]
        own[i] = common[i]  # elements that no other set has are not counted
        assert common.tolist() == own


def test_large_family_of_loosely_near_texts(spark):
    random.seed(12)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(edited(base, random.choice((1, 2, 4, 6))))) for i in range(150)]
    got = minhash_dedup.near_groups(frame(spark, rows), longest=1000, tile=4_000).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
