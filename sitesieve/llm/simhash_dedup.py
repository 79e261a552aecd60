"""Near-duplicates by SimHash, linked through a segment-popcount embedding.

The fingerprint of a document has a bit set where more than half of its shingle hashes have it set. A fingerprint is cut into two
halves and each half into segments of ``SEGMENT_BITS`` bits; the numbers of set bits of the segments are its point in a grid. The Manhattan
distance of two points never exceeds the Hamming distance of the fingerprints, so two fingerprints within 3 bits have, in
at least one half, points at distance 0 or 1. At distance 1 one of the two has exactly one segment larger by one: each fingerprint is therefore
listed in the cell of its own point (as a centre) and in the cells one step up from it, and whatever is linked meets in a cell that
one of them has as its centre. For more bits the fingerprint is cut into more parts than halves, so that the nearest still differ in at most one bit.

Cells are checked exactly, by XOR and bit count. A cell returns a spanning forest of its links instead of all pairs: members that are already
connected are not compared again, so a family of thousands of near copies costs about one comparison per member. Only distinct
fingerprints enter; copies meet again through the fingerprint. Components are found on the links by ``common.components``.

Null text is empty text; an empty text has fingerprint zero. Rows that repeat an id keep one result row each. Null ids come last: the
component id is null only if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window

from ..session import stage
from .common import components, text_key

SEED = 42
SEGMENT_BITS = 2
BITS = 64
# hashes of a long document are counted this many at a time
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the shingles of ``shingle`` words, repeats included, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = iter([b" ".join(words)])
        total = 1
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        hashes = np.fromiter((digest(next(runs), SEED) for _ in range(n)), dtype="<u8", count=n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (tells texts of one id apart) and the fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            made = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), made], names=["doc_id", "key", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {id_type}, key long, fp long")


def cells(prints: DataFrame, max_bits: int) -> DataFrame:
    """(cell, fp, centre) for every distinct fingerprint and part: its own cell, and the cells one step up from it.

    A cell number is the part and the popcounts of its segments, each in as many bits as it needs. There are enough parts for one of them
    to differ in at most one bit.
    """
    parts = max(2, max_bits // 2 + 1)
    width = SEGMENT_BITS.bit_length()
    segments = BITS // SEGMENT_BITS
    listed = []
    for part in range(parts):
        own = range(segments * part // parts, segments * (part + 1) // parts)
        points = [
            F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND((1 << SEGMENT_BITS) - 1)).cast("long") for s in own
        ]
        cell = F.lit(part << (width * len(own))).cast("long")
        for i, point in enumerate(points):
            cell = cell + F.shiftleft(point, width * i)
        listed.append(F.struct(cell.alias("cell"), F.lit(True).alias("centre")))
        if max_bits >= parts:
            for i, point in enumerate(points):
                up = cell + F.lit(1 << (width * i)).cast("long")
                listed.append(F.when(point < SEGMENT_BITS, F.struct(up.alias("cell"), F.lit(False).alias("centre"))))
    return prints.select("fp", F.explode(F.array_compact(F.array(*listed))).alias("at")).select("at.cell", "fp", "at.centre")


def cell_links(fps: np.ndarray, centre: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the centres of a cell and its members."""
    label = np.arange(len(fps))
    parts, found = len(fps), []
    for i in np.flatnonzero(centre):
        if parts == 1:
            break
        other = np.flatnonzero(label != label[i])
        near = other[np.bitwise_count(fps[other] ^ fps[i]) <= max_bits]
        if near.size:
            labels, first = np.unique(label[near], return_index=True)
            found += [(int(fps[i]), int(fps[j])) for j in near[first]]
            label[np.isin(label, labels)] = label[i]
            parts -= len(labels)
    return found


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Verified links (u, v) of distinct fingerprints that connect whatever is within ``max_bits`` bits, fewer than all pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the open cell at the end of what was read
        for frame in chain(batches, [None]):
            if frame is not None:
                held.append((frame["cell"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["centre"].to_numpy()))
                if held[-1][0].size == 0 or held[0][0][0] == held[-1][0][-1]:
                    continue
            if not held:
                continue
            cell, fp, centre = (np.concatenate(x) for x in zip(*held))
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if cell.size else np.array([], int)
            ends = np.r_[starts[1:], cell.size].astype(int)
            if frame is None:
                held = []
            else:
                held = [(cell[starts[-1] :], fp[starts[-1] :], centre[starts[-1] :])]
                starts, ends = starts[:-1], ends[:-1]
            if not starts.size:
                continue
            centres = np.add.reduceat(centre.astype(np.int64), starts) if starts.size else starts
            # the last group of reduceat may reach into the held one
            centres[-1] = centre[starts[-1] : ends[-1]].sum()
            out = []
            for k in np.flatnonzero((ends - starts > 1) & (centres > 0)):
                out += cell_links(fp[starts[k] : ends[k]], centre[starts[k] : ends[k]], max_bits)
            if out:
                yield pd.DataFrame(np.array(out, dtype=np.uint64).view(np.int64), columns=["u", "v"])

    listed = cells(prints, max_bits)
    return listed.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, key, fp, root (the group) and component_id of every row of ``docs``; component_id is the smallest id that can be reached over
    fingerprints within ``max_bits`` bits, that of the row included."""
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fp"), max_bits))
    # fingerprints that reach others; the rest are groups of their own
    member = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = member.groupBy("root").agg(F.min("least").alias("best"))
    linked = member.join(best, "root").select("fp", "root", "best")
    of_print = prints.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id")
    )
    return rows.join(stage(of_print, "print_components"), "fp", "left")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with one of each group left: that of the smallest id (null last), and of texts sharing it the one with the smallest
    key.

    The ids that go are looked up by the join, which moves only them if they are few. Rows that share an id go a second way, on which each is
    told apart by its text.
    """
    marked = stage(near_groups(docs, shingle, max_bits).select("doc_id", "key", "root"), "near_groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = stage(marked.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.doc_id", "best.key"), "keepers")
    told = best.select(F.col("root").alias("of"), F.col("doc_id").alias("id"), F.col("key").alias("text"))
    stays = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text"))
    gone = marked.join(told, F.col("root") == F.col("of")).filter(~stays).select("doc_id")
    several = stage(marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "several")
    plain = docs.join(gone, "doc_id", "left_anti")
    if several.isEmpty():
        return plain.select(*docs.columns)
    plain = plain.join(several, docs["doc_id"].eqNullSafe(several["doc_id"]), "left_anti").select(*docs.columns)
    again = best.join(several.withColumnRenamed("doc_id", "some"), F.col("doc_id").eqNullSafe(F.col("some")), "left_semi")
    again = again.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    first = Window.partitionBy("doc_id", "__own").orderBy("text")
    mixed = (
        docs.withColumn("__own", text_key())
        .join(again, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_semi")
        .withColumn("__nth", F.row_number().over(first))
        .filter("__nth = 1")
    )
    return plain.unionByName(mixed.select(*docs.columns))
