"""Words, near words, forms and roots against plain loops over all pairs."""

import collections
import itertools
import random
import re
import zlib

import pytest

from sitesieve.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string, cell int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 9, "x", 1) for i, t in texts], SCHEMA).repartition(3)


def plain_words(texts, drops=199, length=6, least=5):
    upper = {c: c.lower() for c in spelling.UPPER}
    n = collections.Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(upper.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drops == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_groups(n, factor=5):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and edit_distance(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= factor * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def made_words(seed):
    random.seed(seed)
    words = ["", "abcdef", "éàÿ÷×ß", "ÀÉabcd", "zzzzzz", "zzzzzzz", "zzzzzzzz", "a" * 300, "a" * 301]
    words += ["".join(random.choice("abeéts") for _ in range(random.choice((6, 6, 7, 8)))) for _ in range(150)]
    for w in list(words):
        for _ in range(2):
            at = random.randrange(len(w) + 1)
            words.append(random.choice((w[:at] + w[at + 1 :], w[:at] + random.choice("aeéx") + w[at:], w[:at] + "q" + w[at + 1 :])))
    return words


@pytest.mark.parametrize("tile", [spelling.TILE, 3])
def test_groups_equal_brute_force(spark, tile):
    n = {w: random.Random(w).choice((5, 6, 25, 30, 125, 700)) for w in made_words(tile) if w}
    rows = spark.createDataFrame([(w, c, 0, "clash") for w, c in n.items()], "word string, n long, cell int, counts string").repartition(4)
    got = spelling.spelling_groups(rows, tile=tile).collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == plain_groups(n)


def test_words_of_texts(spark):
    random.seed(5)
    words = [w.upper() if random.random() < 0.2 else w for w in made_words(1)][:60]
    texts = [(random.choice((None, i, i)), ", ".join(random.choices(words, k=200))) for i in range(40)]
    texts += [(7, None), (8, ""), (9, "İSTANBUL ÀBCDEF à" * 6)] * 2
    got = spelling.words(frame(spark, texts)).collect()
    assert {r.word: r.n for r in got} == plain_words(texts) and len(got) == len({r.word for r in got})
    # with a smaller divisor letters are really dropped
    assert {r.word: r.n for r in spelling.words(frame(spark, texts), 3).collect()} == plain_words(texts, 3)


def test_is_near_is_edit_distance_one():
    words = [w for w in made_words(2) if 0 < len(w) < 20][:90]
    for a, b in itertools.product(words, words):
        if len(a) >= 6 <= len(b):
            assert spelling.is_near(a, b) == (edit_distance(a, b) == 1), (a, b)


def test_many_words_with_equal_counts(spark):
    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefgh"), 0, 3000)]
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(4)
    assert spelling.near_words(rows, 100).count() == 0
    assert spelling.spelling_groups(rows, tile=100).count() == 3000


def test_empty(spark):
    assert spelling.spelling_groups(spelling.words(frame(spark, []))).count() == 0
    assert spelling.spelling_groups(spelling.words(frame(spark, [(1, None), (2, "short")]))).count() == 0
