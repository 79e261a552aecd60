"""Near-duplicates by MinHash, joined through an inverted index of signature coordinates.

A document is the set of its distinct shingles of ``SHINGLE`` words, each a 64-bit hash. Its signature has ``COORDINATES`` minima; each pair of a coordinate and
its value is a list of documents. Documents with Jaccard similarity ``percent`` share that share of their coordinates on average; only pairs with
``MATCHES`` matches or more are retained (of 64 coordinates, a link of exactly 85 % has fewer than 38 with a probability below one in a million, and closer ones
far more rarely).

* Equal sets are one row from the start, so copies cost nothing further.
* *Prefix*: pairs with that many matches share one of any ``COORDINATES - MATCHES + 1`` coordinates, so a document is posted only under its rarest ones. Values that
  no other document has come first and need no list: a document with enough of them has no partner at all.
* *Skip*: in a list, documents that are already connected are not counted against each other again. Lists of more than ``LIST`` documents are taken as
  connected as a whole, which can only add candidates.
* Candidates form clusters. The texts of clusters are read again, the others pass by a filter of fixed size; their full sets meet once, in tiles of bounded size, and links are confirmed on them exactly; a tile keeps a
  spanning forest of its links. Where a cluster has several tiles, documents outside its largest part are then held against every tile, so no link
  between two parts is lost.

Null or empty text and text without words is an empty set, linked with nothing. With fewer words than a shingle the whole sequence is one shingle. Rows that repeat
keep one result row each. Null ids come last: a component id is null only if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import components, text_key

SHINGLE = 3
PERCENT = 85
COORDINATES = 64
MATCHES = 38
#: documents of a list that are counted against each other
LIST = 1_000
#: shingles of a cluster that one task holds
TILE = 1_000_000
#: bits of the filter that tells which texts are needed again; of fixed size (2 MB), so it may be broadcast
FILTER_BITS, BLOCK_BITS = 1 << 24, 1 << 15
#: word hashes kept at a time, and hashes minimised at a time
CACHE, CHUNK = 1 << 20, 1 << 12

_random = np.random.default_rng(20250117)
FACTORS = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
MIXERS = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
SALTS = _random.integers(0, 1 << 64, 2, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        if (known := cache.get(word)) is None:
            known = cache[word] = xxhash.xxh64_intdigest(word)
        hashes[i] = known
    width = min(shingle, len(words))
    made = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        # a factor for each place; beyond the table the running value is mixed in between
        if i and i % len(MIXERS) == 0:
            made = _mixed(made)
        made += hashes[i : len(words) - width + 1 + i] * MIXERS[i % len(MIXERS)]
    return np.unique(_mixed(made))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of every coordinate, as 32-bit numbers."""
    least = np.full(COORDINATES, np.uint64((1 << 64) - 1))
    for start in range(0, len(hashes), CHUNK):
        spread = hashes[start : start + CHUNK, None] * FACTORS
        least = np.minimum(least, (spread ^ (spread >> np.uint64(29))).min(axis=0))
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the text), n_shingles, two hashes of the set, the signature and its short form (16 bits a coordinate) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        names = ["doc_id", "key", "n_shingles", "h1", "h2", "signature", "short"]
        for batch in batches:
            n, h1, h2, long, short = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), shingle, cache)
                n.append(len(hashes))
                for h, salt in zip((h1, h2), SALTS):
                    h.append(int(_mixed(hashes ^ salt).sum(dtype=np.uint64).view(np.int64)))
                of_set = signature(hashes) if len(hashes) else None
                long.append(None if of_set is None else of_set.view(np.int32))
                short.append(None if of_set is None else of_set.astype(np.uint16).tobytes())
            columns = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(long, pa.list_(pa.int32())), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {id_type}, key long, n_shingles long, h1 long, h2 long, signature array<int>, short binary"
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, made)


def postings(sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """coordinate, value, length of the list, sid: every set under the rarest coordinates of which it shares one with any partner."""
    posted = sets.select("sid", F.posexplode("signature").alias("coordinate", "value"))
    lists = posted.groupBy("coordinate", "value").agg(F.count("*").alias("length")).filter("length > 1")
    shared = posted.join(lists, ["coordinate", "value"]).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("length", "coordinate", "value"))).alias("at"))
    # coordinates that no other set shares are the rarest
    prefix = F.size("at") - (matches - 1)
    return shared.filter(prefix > 0).select("sid", F.explode(F.slice("at", F.lit(1), prefix)).alias("at")).select("at.*", "sid")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in their first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


def _alike_sizes(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (sizes > 0)


def counted_together(sizes: np.ndarray, shorts: np.ndarray, percent: int, matches: int) -> list[tuple[int, int]]:
    """Pairs of places with enough matches that connect what such pairs connect; connected ones are skipped."""
    label, found = np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[_alike_sizes(sizes[rest], sizes[i], percent)]
        if rest.size:
            near = rest[(shorts[rest] == shorts[i]).sum(axis=1) >= matches]
            labels, first = np.unique(label[near], return_index=True)
            found += [(i, int(j)) for j in near[first]]
            if labels.size:
                label[np.isin(label, labels)] = label[i]
    return found


def candidates(sets: DataFrame, percent: int = PERCENT, matches: int = MATCHES, longest: int = LIST) -> DataFrame:
    """Pairs (u, v) of sets that connect all sets with enough matching coordinates."""
    posted = stage(postings(sets, matches), "postings")
    star = posted.filter(F.col("length") > longest)
    star = star.join(star.groupBy("coordinate", "value").agg(F.min("sid").alias("v")), ["coordinate", "value"]).select(F.col("sid").alias("u"), "v").filter("u <> v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            if len(rows) > 1:
                shorts = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), COORDINATES)
                pairs = counted_together(np.array([r[1] for r in rows]), shorts, percent, matches)
                if pairs:
                    yield _edges([(rows[i][0], rows[j][0]) for i, j in pairs])

    short = posted.filter(F.col("length") <= longest).select("coordinate", "value", "sid").join(sets.select("sid", "n_shingles", "short"), "sid")
    short = short.select("coordinate", "value", "sid", "n_shingles", "short").repartition("coordinate", "value").sortWithinPartitions("coordinate", "value")
    return short.mapInArrow(run, "u long, v long").unionByName(star).distinct()


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Postings:
    """The sets of a tile by element, to count what one set has in common with all others at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, element = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(element, kind="stable")
        self.n, self.owner = len(sets), owner[order]
        self.start = np.r_[0, np.cumsum(np.bincount(element))]
        self.element, self.of_set = element, np.r_[0, np.cumsum(sizes)]

    def common(self, i: int) -> np.ndarray:
        """Elements that set ``i`` shares with each of the sets."""
        elements = self.element[self.of_set[i] : self.of_set[i + 1]]
        starts, lengths = self.start[elements], self.start[elements + 1] - self.start[elements]
        starts, lengths = starts[lengths > 1], lengths[lengths > 1]
        before = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) + np.repeat(starts - before, lengths)
        return np.bincount(self.owner[places], minlength=self.n)


#: from so many candidates on, a set is counted against the whole tile instead of one by one
MANY = 16


def confirmed(sids: list[int], parts: list[int], asks: list[bool], sets: list[np.ndarray], percent: int, matches: int) -> list[tuple[int, int]]:
    """Links of the sets that ask with all others of a tile, confirmed on the full sets; those of one part are known to be connected and skipped."""
    found, postings = [], None
    sizes = np.array([len(s) for s in sets])
    shorts = np.array([signature(s) for s in sets]).astype(np.uint16)
    label = np.array(parts, dtype=np.int64)
    for i in np.flatnonzero(asks):
        rest = np.flatnonzero((label != label[i]) & _alike_sizes(sizes, sizes[i], percent))
        rest = rest[(shorts[rest] == shorts[i]).sum(axis=1) >= matches]
        if len(rest) >= MANY:
            postings = postings or _Postings(sets)
            common = postings.common(i)[rest]
            rest = rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)]
            linked = rest
        else:
            linked = [j for j in rest if is_link(sets[i], sets[j], percent)]
        for j in linked:
            if label[j] != label[i]:
                found.append((sids[i], sids[j]))
                label[label == label[j]] = label[i]
    return found


def needed_again(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``docs`` (key) that may be among ``named`` (key): a bit for each key, so that texts that are surely not needed stay where they are.

    With many more keys than bits every row passes, which costs a shuffle of the texts but loses nothing.
    """
    place = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = named.groupBy(F.floor(place / BLOCK_BITS).alias("__block")).agg(F.bitmap_construct_agg(place % BLOCK_BITS).alias("__bits"))
    asked = docs.withColumns({"__block": F.floor(place / BLOCK_BITS), "__place": place % BLOCK_BITS})
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = asked.join(F.broadcast(bits), "__block").withColumn("__byte", byte)
    return met.filter("(shiftright(__byte, cast(__place % 8 AS int)) & 1) = 1").select(*docs.columns)


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES, longest: int = LIST, tile: int = TILE) -> DataFrame:
    """Confirmed links (u, v) that connect all sets that links connect."""
    cluster = stage(components(candidates(sets, percent, matches, longest)).withColumnRenamed("node", "sid"), "clusters")
    members = cluster.join(sets.select("sid", "n_shingles", "doc_id", "key"), "sid")
    tiles = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / tile).cast("int").alias("tiles"))
    members = members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles").cast("long")).cast("int"))
    members = stage(members.select("root", "tiles", "tile", "sid", "doc_id", "key"), "members")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            made = pa.array([shingle_set(t.as_py(), shingle, cache).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("root", "tile", "part", "asks", "sid")] + [made], names=["root", "tile", "part", "asks", "sid", "hashes"])

    def compared(asked: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _groups(batches, 2):
                # a set comes once for each row that repeats its document, and once more if it asks in its own tile
                once = {r[2]: r for r in sorted(rows, key=lambda r: r[1])}
                rows = list(once.values())
                sets_of = [np.frombuffer(r[3], np.uint64) for r in rows]
                found = confirmed([r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows], sets_of, percent, matches)
                if found:
                    yield _edges(found)

        named = asked.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "root", "tile", "part", "asks", "sid")
        texts = needed_again(docs.select("doc_id", "text", text_key().alias("key")), asked.select("key")).withColumnRenamed("key", "__own")
        met = texts.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")))
        sets_of = met.select("root", "tile", "part", "asks", "sid", "text").mapInArrow(hashed, "root long, tile int, part long, asks boolean, sid long, hashes binary")
        return sets_of.repartition("root", "tile").sortWithinPartitions("root", "tile").mapInArrow(run, "u long, v long")

    first = stage(compared(members.withColumns({"part": F.col("sid"), "asks": F.lit(True)})), "links")
    several = stage(members.filter("tiles > 1"), "several")
    if several.isEmpty():
        return first
    part = components(first).select(F.col("node").alias("sid"), F.col("root").alias("part"))
    several = stage(several.join(part, "sid", "left").withColumn("part", F.coalesce("part", "sid")), "several")
    sizes = several.groupBy("root", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("n", "part")).alias("most")).select("root", F.col("most.part").alias("largest"))
    outside = several.join(largest, "root").filter("part <> largest")
    asking = outside.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("asks", F.lit(True)).drop("largest")
    open_clusters = several.join(outside.select("root").distinct(), "root", "left_semi").withColumn("asks", F.lit(False))
    return first.unionByName(stage(compared(asking.unionByName(open_clusters)), "links"))


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES, longest: int = LIST, tile: int = TILE
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; component_id is the smallest id that links lead to, that of the row included."""
    rows = stage(signatures(docs, shingle), "signatures")
    of_set = ["n_shingles", "h1", "h2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    sets = rows.filter("n_shingles > 0").groupBy(*of_set).agg(first, F.first("signature").alias("signature"), F.first("short").alias("short"))
    sets = stage(
        sets.select(F.monotonically_increasing_id().alias("sid"), *of_set, F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), "signature", "short"),
        "sets",
    )
    group = components(links(docs, sets, shingle, percent, matches, longest, tile)).withColumnRenamed("node", "sid")
    member = sets.select("sid", "doc_id", *of_set).join(group, "sid")
    best = member.groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = stage(member.join(best, "root").select("sid", "least"), "linked")
    of_each = sets.select("sid", "doc_id", *of_set).join(linked, "sid", "left").select(*of_set, F.coalesce("least", "doc_id").alias("component_id"))
    found = rows.select("doc_id", *of_set).join(stage(of_each, "of_each"), of_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
