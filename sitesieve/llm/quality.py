"""Quality of documents from weak labels.

Eight overlapping heuristic labellers look at the shapes of a document's tokens and vote bad, good or nothing. Expectation-
maximisation over the counts of all vote patterns of the whole corpus (at most 3**8 of them, whatever the size of the corpus) estimates
how accurate each labeller is when it votes, and from that the posterior of each pattern. The posteriors are the soft labels
of a logistic scorer over hashed token shapes, fitted on a bounded sample of documents; it then scores every document.

Bound of the sample: ``SAMPLE`` documents (about), those with the smallest hash of id and text; counts, votes and scores cover everything.
Words and texts are whole, and whatever the script: letters outside ASCII are one class of their own.
Null and empty texts have no tokens and get score 0; they are not kept. Rows that repeat get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import text_key

SAMPLE = 20_000
BUCKETS = 1 << 12
ROUNDS = 60
KEEP = 0.35

ABSTAIN, BAD, GOOD = 0, 1, 2
# right and wrong votes of each labeller that count as seen before any document
PRIOR = (8.0, 1.0)
# share of good documents before any vote; neutral, so that an accuser that speaks alone is not outvoted by the many good documents
GOOD_SHARE = 0.5

# bytes to classes: capital, small letter, digit, letter beyond ASCII; continuation bytes go, white space and marks stay
_CLASS = bytearray(range(256))
for _i in range(256):
    if 65 <= _i <= 90:
        _CLASS[_i] = 65
    elif 97 <= _i <= 122:
        _CLASS[_i] = 97
    elif 48 <= _i <= 57:
        _CLASS[_i] = 48
    elif _i >= 192:
        _CLASS[_i] = 117
CLASS = bytes(_CLASS)
FOLLOWING = bytes(range(128, 192))

MARKS = re.compile(rb"([*#$%&=~^+|<>@_\\/])\1")
LOUD = re.compile(rb"[!?]{2}")
CAPITALS = re.compile(rb"AA")
LETTER = re.compile(rb"[A0au]")
END = re.compile(rb"[A0au][.?!:;]$")
PLAIN = re.compile(rb"[(\"'\[]?[A0au'-]+[.,;:!?]?[)\"'\]]?")


@dataclass(frozen=True)
class Profile:
    n: int
    shapes: Counter
    repeats: float
    variety: float


def profile(text: str | None) -> Profile | None:
    """Token shapes of a text, the share of words equal to the one before, and of different words; None without a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return None
    classes = np.frombuffer(raw.translate(CLASS, FOLLOWING), dtype=np.uint8)
    third = np.zeros(classes.size, dtype=bool)  # of a run of one class the first two stay
    third[2:] = (classes[2:] == classes[1:-1]) & (classes[2:] == classes[:-2])
    shapes = Counter(classes[~third].tobytes().split())
    n = len(words)
    return Profile(n, shapes, sum(map(eq, words, words[1:])) / n, len(set(words)) / n)


def _over(x: float, most: float) -> int:
    return BAD if x > most else ABSTAIN


def votes(p: Profile) -> list[int]:
    """The votes of the labellers, in the order of ``LABELLERS``. All but the last only ever accuse."""
    marks = loud = capitals = bare = ends = plain = total = 0
    for shape, n in p.shapes.items():
        total += n
        marks += n * bool(MARKS.search(shape))
        loud += n * bool(LOUD.search(shape))
        capitals += n * bool(CAPITALS.search(shape) and b"a" not in shape)
        bare += n * (not LETTER.search(shape))
        ends += n * bool(END.search(shape))
        plain += n * bool(PLAIN.fullmatch(shape))
    total = max(total, 1)
    return [
        _over(marks / total, 0.1),
        _over(loud / total, 0.1),
        _over(capitals / total, 0.25),
        _over(bare / total, 0.12),
        _over(p.repeats, 0.15),
        ABSTAIN if p.n < 40 else _over(-p.variety, -0.12),
        ABSTAIN if p.n < 30 else _over(-ends, -1),
        BAD if plain < 0.6 * total else GOOD if plain > 0.85 * total and ends > 0.01 * total and p.repeats < 0.05 else ABSTAIN,
    ]


LABELLERS = ("doubled marks", "loud ends", "capitals", "bare marks", "repeats", "variety", "sentence ends", "plain prose")
PLACES = 3 ** np.arange(len(LABELLERS))


def features(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a document: buckets and values."""
    found: dict[int, float] = {}
    total = sum(p.shapes.values()) or 1
    for shape, n in p.shapes.items():
        bucket = xxhash.xxh32_intdigest(shape[:16]) % BUCKETS
        found[bucket] = found.get(bucket, 0.0) + n / total
    buckets = np.fromiter(found, dtype=np.int32, count=len(found))
    values = np.sqrt(np.fromiter(found.values(), dtype=np.float64, count=len(found)))
    more = [f"repeats {int(10 * p.repeats)}", f"variety {int(10 * p.variety)}"]
    extra = np.array([xxhash.xxh32_intdigest(x) % BUCKETS for x in more], dtype=np.int32)
    return np.concatenate([buckets, extra]), np.concatenate([values, np.full(extra.size, 0.5)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    #: accuracy of each labeller and share of good documents, as the EM estimated them
    accuracy: np.ndarray
    good_share: float
    #: posterior of being good by vote pattern
    posterior: dict[int, float]

    def score(self, text: str | None) -> float:
        p = profile(text)
        if p is None:
            return 0.0
        at, values = features(p)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ values + self.bias, -40, 40))))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracy of each labeller, share of good documents, posterior of good by row of ``patterns`` (labellers as columns).

    A labeller that votes is right with its accuracy, whatever the truth; an abstention says nothing.
    """
    accuse, praise = patterns == BAD, patterns == GOOD
    post = np.where(accuse.sum(1) > praise.sum(1), 0.1, 0.9)
    for _ in range(ROUNDS):
        right = (counts[:, None] * (accuse * (1 - post[:, None]) + praise * post[:, None])).sum(0)
        spoken = (counts[:, None] * (accuse | praise)).sum(0)
        accuracy = (right + PRIOR[0]) / (spoken + sum(PRIOR))
        weight = np.log(accuracy) - np.log1p(-accuracy)
        odds = np.log(GOOD_SHARE) - np.log1p(-GOOD_SHARE) + (praise.astype(float) - accuse) @ weight
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return accuracy, float((counts * post).sum() / counts.sum()), post


def fit_linear(rows: np.ndarray, at: np.ndarray, values: np.ndarray, soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for soft labels; entry i says that document rows[i] has values[i] in bucket at[i]."""
    w, bias, n = np.zeros(BUCKETS), 0.0, soft.size
    grad2, grad2_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(400):
        z = np.bincount(rows, weights=values * w[at], minlength=n) + bias
        diff = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - soft
        g = np.bincount(at, weights=values * diff[rows], minlength=BUCKETS) / n + 1e-5 * w
        gb = diff.mean()
        grad2 += g * g
        grad2_bias += gb * gb
        w -= 0.5 * g / np.sqrt(grad2)
        bias -= 0.5 * gb / np.sqrt(grad2_bias)
    return w, float(bias)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the votes on all of ``docs`` and the scorer from the posteriors of a sample of about ``sample`` documents."""
    n = docs.count()
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 11) * F.lit(2.0**-53)
    rows = docs.select("doc_id", text_key().alias("key"), "text").select("text", (rank < sample / max(n, 1)).alias("chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, chosen in zip(batch.column("text"), batch.column("chosen")):
                p = profile(text.as_py())
                if p is not None:
                    at, values = features(p) if chosen.as_py() else (None, None)
                    out.append((int(np.dot(votes(p), PLACES)), at, values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], pa.list_(pa.int32())),
                    pa.array([x[2] for x in out], pa.list_(pa.float64())),
                ],
                names=["pattern", "at", "value"],
            )

    voted = stage(rows.mapInArrow(run, "pattern int, at array<int>, value array<double>"), "votes")
    counts = voted.groupBy("pattern").count().toPandas()  # at most 3**8 rows
    if counts.empty:
        return Model(np.zeros(BUCKETS), 0.0, np.full(len(LABELLERS), 0.5), 0.5, {})
    counts = counts.sort_values("pattern", ignore_index=True)
    coded = counts["pattern"].to_numpy()
    accuracy, share, post = expectation_maximisation(coded[:, None] // PLACES % 3, counts["count"].to_numpy(dtype=float))
    posterior = dict(zip(coded.tolist(), post.tolist()))
    # the bounded sample, in an order that does not depend on how it comes in
    chosen = sorted((r["pattern"], r["at"], r["value"]) for r in voted.filter("at IS NOT NULL").collect())
    rows_of = np.repeat(np.arange(len(chosen)), [len(x[1]) for x in chosen])
    at = np.array([b for x in chosen for b in x[1]], dtype=np.int64)
    values = np.array([v for x in chosen for v in x[2]])
    soft = np.array([posterior[x[0]] for x in chosen])
    weights, bias = fit_linear(rows_of, at, values, soft) if len(chosen) else (np.zeros(BUCKETS), 0.0)
    return Model(weights, bias, accuracy, share, posterior)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each row added, in the order and partitions they come in."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored("text"))


def judge(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, score and kept for every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, sample), "score")
    return scored.select("doc_id", "score", (F.col("score") >= keep).alias("kept"))


def drop_poor(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps."""
    return score(docs, fit(docs, sample), "__score").filter(F.col("__score") >= keep).drop("__score")
