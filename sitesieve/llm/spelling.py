"""Spelling variants: words within one edit, found in tries of letter-group counts.

The letters are put into ``GROUPS``; a word is the vector of how many of its letters each group has. One inserted letter raises one count by one
(a surplus), one deleted letter lowers one (a deficit), a replaced one does both or stays in its group. A trie arranges the words by their counts, group after group,
and a depth-first search for a word follows the branches that spend at most one surplus and one deficit; the words at the leaves it reaches
are verified letter by letter.

Sums of the counts of the first ``TOP`` pairs of groups, the coarse top of the trie, tell which cell a word lies in. Each word is looked for in its own cell and in
the cells that one surplus and one deficit lead to; of the two ways to meet between two cells only the upward one is taken. Cells with more than ``TILE`` words are cut into tiles by
hash and asked tile by tile, so a task holds the trie of one tile, however many words share their counts. A word has a bounded number of neighbours (its length times the alphabet), so links
grow with the words.

Counting words is plain aggregation, combined before the shuffle. Null text has no words; a null id is empty in the rule that drops
letters; rows that repeat count again; ties between forms go to the word that is first in code-point order. No words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import text_of

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters of each group; the last group holds all others
GROUPS = ("e", "a", "t", "i", "n", "o", "r", "s", "h", "l", "d", "u", "cm", "gpf", "bvwy")
#: pairs of groups whose counts make the cell
TOP = 4
#: words in the trie of a task
TILE = 20_000
#: counts in the number of a cell are told apart up to here; beyond, neighbours still differ by at most one
MOST = (1 << 15) - 2
#: contract of the query: one run in so many loses a letter
DROPS = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5


def _ascii_lower(word: Column) -> Column:
    """A-Z in small letters, others as they are."""
    return F.when(word.rlike("[À-Þ]"), F.translate(word, UPPER, LOWER)).otherwise(F.lower(word))


def words(docs: DataFrame, drops: int = DROPS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the runs of letters of whole texts. A run of which ``crc32("<doc_id>:<run>")`` is a multiple of ``drops`` loses one letter (0: none does)."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run"))
    # shorter ones cannot become long enough; the generator keeps costly expressions from being computed anew wherever they are used
    runs = runs.filter(F.length("run") >= least_length).select("doc_id", F.explode(F.array(_ascii_lower(F.col("run")))).alias("word"))
    if drops:
        mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        runs = runs.select("word", F.explode(F.array(mark)).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % drops == 0, less).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def vector() -> Column:
    """How many letters of ``word`` each group has, the last one all others."""
    counts = [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS]
    others = F.length(F.translate("word", "".join(GROUPS), ""))
    return F.array(*counts, others)


def _cell(step: tuple[int, ...]) -> Column:
    """Number of the cell that differs by ``step`` from that of ``counts``; null where a count would be below zero."""
    number, possible = F.lit(0).cast("long"), F.lit(True)
    for i, change in enumerate(step):
        count = F.least(F.col("counts")[2 * i] + F.col("counts")[2 * i + 1], F.lit(MOST)).cast("long") + change
        number = number * (MOST + 2) + count
        if change < 0:
            possible = possible & (count >= 0)
    return F.when(possible, number)


def _steps_up() -> list[tuple[int, ...]]:
    """Changes of the counts of a cell that spend at most one surplus and one deficit, the first change being the surplus."""
    steps = []
    for up in range(TOP):
        for down in (None, *range(up + 1, TOP)):
            steps.append(tuple(1 if i == up else -1 if i == down else 0 for i in range(TOP)))
        # a deficit before the surplus is the same pair seen from the other cell
    return steps


def is_near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns one into the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    half = len(b) // 2
    if a[:half] != b[:half] and a[len(a) - half :] != b[len(b) - half :]:
        return False
    i, end = 0, len(b)
    while i < end and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] if len(a) > len(b) else i < end and a[i + 1 :] == b[i + 1 :]


def trie_of(members: list[tuple[str, str, int]]) -> dict:
    """Nested by the counts of one group after the other, from (counts, word, n); leaves are lists of (word, n)."""
    root: dict = {}
    at, leaf = None, None
    for written, word, n in members:
        if written != at:
            at, node, counts = written, root, parsed(written)
            for count in counts[:-1]:
                node = node.setdefault(count, {})
            leaf = node.setdefault(counts[-1], [])
        leaf.append((word, n))
    return root


def parsed(counts: str) -> list[int]:
    return [int(count) for count in counts.split(",")]


def within_budget(root: dict, counts: list[int]) -> list[tuple[str, int]]:
    """The words whose counts have at most one surplus and one deficit against ``counts``, depth first."""
    found, depth = [], len(counts)
    open_nodes = [(root, 0, 1, 1)]
    while open_nodes:
        node, level, surplus, deficit = open_nodes.pop()
        if level == depth:
            found += node
            continue
        count = counts[level]
        if (child := node.get(count)) is not None:
            open_nodes.append((child, level + 1, surplus, deficit))
        if surplus and (child := node.get(count + 1)) is not None:
            open_nodes.append((child, level + 1, 0, deficit))
        if deficit and (child := node.get(count - 1)) is not None:
            open_nodes.append((child, level + 1, surplus, 0))
    return found


NEAR = "word string, n long, near string, near_n long"


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n, near, near_n of all pairs of near words of ``vocabulary`` (word, n), in both directions."""
    counted = vocabulary.select("word", "n", vector().alias("counts"))
    # counts travel as text: most rows share them with the row before, and are not taken apart again
    written = F.array_join(F.col("counts").cast("array<string>"), ",")
    asked = [F.struct(_cell((0,) * TOP).alias("cell"), F.lit(1).alias("role"))]
    asked += [F.struct(_cell(step).alias("cell"), F.lit(2).alias("role")) for step in _steps_up()]
    counted = stage(counted.select("word", "n", written.alias("counts"), _cell((0,) * TOP).alias("cell"), F.array(*asked).alias("asked")), "counted")
    cells = counted.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    # 0: in the trie, 1: asked in the own cell, 2: asked in a cell further up
    members = counted.join(cells, "cell").select(
        "cell", F.pmod(F.xxhash64("word"), F.col("tiles").cast("long")).cast("int").alias("tile"), F.lit(0).alias("role"), "counts", "word", "n"
    )
    probes = counted.select("counts", "word", "n", F.explode("asked").alias("at")).select("at.cell", "at.role", "counts", "word", "n")
    probes = probes.join(cells, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "role", "counts", "word", "n"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root, members, last, reached = None, {}, [], None, []
        for batch in batches:
            out = []
            for cell, part, role, counts, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if (cell, part) != at:
                    at, root, members, last = (cell, part), None, [], None
                if role == 0:
                    members.append((counts, word, n))
                    continue
                if root is None:
                    root, members = trie_of(members), []
                if counts != last:
                    last, reached = counts, within_budget(root, parsed(counts))
                for other, m in reached:
                    if is_near(word, other):
                        out.append((word, n, other, m))
                        if role == 2:
                            out.append((other, m, word, n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"]
                )

    order = ("cell", "tile")
    return members.unionByName(probes).repartition(*order).sortWithinPartitions(*order, "role", "counts").mapInArrow(run, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word in ``forms`` (word, form): the last word that forms lead to.

    Pointers are doubled: each round is a written table, and forms occur several times as often as their word, so rounds are the logarithm of a logarithm of the
    text.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_groups(vocabulary: DataFrame, factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary`` (word, n, each word once).

    The form is the most frequent near word if it occurs at least ``factor`` times as often.
    """
    vocabulary = stage(vocabulary.select("word", "n"), "vocabulary")
    best = near_words(vocabulary, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    )
    enough = -F.col("best.rank") >= factor * F.col("n")
    judged = stage(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.rank")).alias("form_n"),
        ),
        "judged",
    )
    last = roots(judged.filter("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
