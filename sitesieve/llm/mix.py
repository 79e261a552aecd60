"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; target over source size is the number of copies each of its documents should have, and the
whole part of it is taken as it is. The fractions are rounded in pairs: mass, in words, moves at random from one document of a pair to
the other until one of the two is whole, which leaves the words of the pair and the expected copies of each unchanged; the other one meets
the next document. Each source is dealt into blocks of about ``BLOCK`` documents by a hash; a block leaves at most one fractional document,
and these residuals are combined in blocks again, up a reduction tree, until a source has one. That one is rounded to the nearer side,
and what this adds or lacks is made up by turning smaller documents of the source, wherever they were settled, so that the words taken come
closer to the target than the smallest document that can be turned, as far as there are such documents. All randomness is a hash of seed, level and the pair.

Size of a document: runs of characters other than ASCII white space. Null text has size 0 and is never taken. A null source is a source
of its own, last in order. Rows that repeat are rows of their own, numbered; no group of one source, hash or id is ever
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import let
from ..session import stage
from .common import text_key, text_of, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SEED = 20

UNIT = ("doc_id", "key", "nth", "size")
KIND = "array<struct<unit:struct<size:bigint,doc_id:{id},key:bigint,nth:bigint>,p:double,up:int>>"


def units(docs: DataFrame) -> DataFrame:
    """(source, doc_id, key, nth, size), one row for each row of ``docs``; rows that repeat are numbered."""
    rows = docs.select("source", "doc_id", text_key().alias("key"), word_count(text_of()).alias("size"))
    counted = rows.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n"))
    return counted.select("source", "doc_id", "key", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) for ``sizes(source, source_size, n)``, one row per source.

    Sources in code point order, null last, have the weights in turn and share ``share`` of all words. A target stops at ``most`` times
    the source's size and the excess goes to the others by weight: filled in the order of size over weight, a source is full if
    its share of what the ones before it leave would exceed what it may have.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = F.col("source_size") * F.lit(float(most))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)

    def so_far(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0.0))

    rows = sizes.withColumn("weight", weight).withColumn("full", full)
    rows = rows.withColumn("pool", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(every))
    left = (F.col("pool") - so_far("full")) * F.col("weight") / (F.col("weights") - so_far("weight"))
    rows = rows.withColumn("capped", F.col("full") <= left)
    taken = F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0.0)).over(every)
    others = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(every)
    fair = (F.col("pool") - taken) * F.col("weight") / F.when(others > 0, others)
    return rows.select("source", "source_size", "n", F.when(F.col("capped"), F.col("full")).otherwise(fair).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that is a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _whole(p: Column) -> Column:
    return (p <= 1e-12) | (p >= 1 - 1e-12)


def _fold(members: Column, level: int) -> Column:
    """Round the members of a block, structs of unit and p, one after another. Returns an array of structs of unit, p and up, with up
    null for the one that may be left."""

    def entry(unit: Column, p: Column, up: Column) -> Column:
        return F.struct(unit.alias("unit"), p.alias("p"), up.cast("int").alias("up"))

    def settled(unit: Column, p: Column) -> Column:
        return F.when(_whole(p), F.array(entry(unit, p, F.round(p)))).otherwise(F.array().cast(kind))

    def pair(acc: Column, x: Column) -> Column:
        a, b = acc["unit"], x["unit"]
        amounts = F.struct(
            ((1 - acc["p"]) * a["size"]).alias("room_a"),
            (acc["p"] * a["size"]).alias("mass_a"),
            ((1 - x["p"]) * b["size"]).alias("room_b"),
            (x["p"] * b["size"]).alias("mass_b"),
            _uniform(F.lit(SEED), F.lit(level), a["doc_id"], a["key"], a["nth"], b["doc_id"], b["key"], b["nth"]).alias("u"),
        )

        def moved(m: Column) -> Column:
            up, down = F.least(m["room_a"], m["mass_b"]), F.least(m["mass_a"], m["room_b"])
            to_a = m["u"] * (up + down) < down
            new_a = F.when(
                to_a, F.when(m["room_a"] <= m["mass_b"], 1.0).otherwise(acc["p"] + up / a["size"])
            ).otherwise(F.when(m["mass_a"] <= m["room_b"], 0.0).otherwise(acc["p"] - down / a["size"]))
            new_b = F.when(
                to_a, F.when(m["mass_b"] <= m["room_a"], 0.0).otherwise(x["p"] - up / b["size"])
            ).otherwise(F.when(m["room_b"] <= m["mass_a"], 1.0).otherwise(x["p"] + down / b["size"]))
            return F.struct(new_a.alias("a"), new_b.alias("b"))

        def after(p: Column) -> Column:
            open_a = ~_whole(p["a"])
            return F.struct(
                F.when(open_a, a).otherwise(b).alias("unit"),
                F.when(open_a, p["a"]).otherwise(F.when(~_whole(p["b"]), p["b"])).alias("p"),
                F.concat(acc["done"], settled(a, p["a"]), settled(b, p["b"])).alias("done"),
            )

        return let(let(amounts, moved), after)

    kind = KIND.format(id=_fold.id_type)
    first = F.get(members, F.lit(0))
    zero = F.struct(first["unit"].alias("unit"), F.lit(None).cast("double").alias("p"), F.array().cast(kind).alias("done"))
    end = F.aggregate(
        members,
        zero,
        lambda acc, x: F.when(
            acc["p"].isNull(), F.struct(x["unit"].alias("unit"), x["p"].alias("p"), acc["done"].alias("done"))
        ).otherwise(pair(acc, x)),
    )
    rest = let(end, lambda e: F.when(e["p"].isNull(), e["done"]).otherwise(F.concat(e["done"], F.array(entry(e["unit"], e["p"], F.lit(None))))))
    return rest


def _changed(decided: DataFrame, masses: DataFrame) -> DataFrame:
    """``decided`` with documents turned so that the words of each source come closer to ``masses(of, mass)``, the larger sizes first.

    How many documents of a size are turned follows from the number of each size; which ones, from a hash.
    """
    taken = decided.groupBy("source").agg(F.sum(F.col("up") * F.col("size")).alias("taken"))
    errors = taken.join(masses, F.col("source").eqNullSafe(F.col("of"))).select("of", (F.col("taken") - F.col("mass")).alias("err"))
    rows = decided.join(errors, F.col("source").eqNullSafe(F.col("of"))).withColumn("room", F.abs("err") + F.lit(1e-6))
    rows = rows.filter((F.col("size") <= F.col("room")) & (F.col("up") == F.when(F.col("err") > 0, 1).otherwise(0)))
    sizes = rows.groupBy("source", "size", "room").agg(F.count("*").alias("n"))
    each = sizes.groupBy("source", "room").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))

    def turn(acc: Column, e: Column) -> Column:
        def after(k: Column) -> Column:
            more = F.array(F.struct(e["size"].alias("size"), e["n"].alias("n"), k.alias("k")))
            return F.struct((acc["left"] - k * e["size"]).alias("left"), F.when(k > 0, F.concat(acc["turned"], more)).otherwise(acc["turned"]).alias("turned"))

        return let(F.least(e["n"], F.floor(acc["left"] / e["size"]).cast("long")), after)

    none = F.array().cast("array<struct<size:bigint,n:bigint,k:bigint>>")
    plan = each.select("source", F.explode(F.aggregate("sizes", F.struct(F.col("room").alias("left"), none.alias("turned")), turn)["turned"]).alias("e"))
    plan = stage(plan.select(F.col("source").alias("to"), F.col("e.size").alias("words"), F.col("e.n").alias("several"), "e.k"), "turned_sizes")
    # the first k of a size in the order of a hash, counted over small ranges of the hash, then inside of one
    u = _uniform(F.lit(SEED), F.lit(-1), "doc_id", "key", "nth")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("to")) & (F.col("size") == F.col("words"))).withColumn("u", u)
    rows = rows.select("source", *UNIT, "k", "u", F.floor(F.col("u") * F.ceil(F.col("several") / BLOCK)).alias("range"))
    ranges = rows.groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("to"), F.col("size").alias("words"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("to")) & (F.col("size") == F.col("words")) & (F.col("range") == F.col("at")))
    place = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("u", "doc_id", "key", "nth"))
    rows = rows.filter("before < k").withColumn("place", place + F.col("before")).filter("place <= k")
    turned = stage(rows.select(F.col("source").alias("to"), *(F.col(c).alias(f"__{c}") for c in UNIT), F.lit(True).alias("turned")), "turned")
    same = F.col("source").eqNullSafe(F.col("to"))
    for c in UNIT:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return decided.join(turned, same, "left").select("source", *UNIT, F.when(F.col("turned"), 1 - F.col("up")).otherwise(F.col("up")).alias("up"))


def rounded(fractions: DataFrame, most_rows: int) -> DataFrame:
    """(source, doc_id, key, nth, size, up): 0 or 1 for each row of ``fractions(source, doc_id, key, nth, size, p, n)`` with 0 < p < 1.

    ``n`` is the number of rows of the source at most, ``most_rows`` the largest of these.
    """
    _fold.id_type = fractions.schema["doc_id"].dataType.simpleString()
    open_rows = fractions.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    decided, level, most = None, 0, most_rows
    while True:
        block = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "doc_id", "key", "nth"), F.col("blocks"))
        # the larger documents of a block meet each other first
        member = F.struct((-F.col("size")).alias("rank"), F.struct("size", "doc_id", "key", "nth").alias("unit"), "p")
        most = -(-most // BLOCK)
        # the last one of a source is rounded where the source has one block, whatever other sources have
        up = F.when(F.col("blocks") <= 1, F.coalesce("e.up", F.round("e.p").cast("int"))).otherwise(F.col("e.up"))
        folded = (
            open_rows.groupBy("source", "blocks", block.alias("block"))
            .agg(F.sort_array(F.collect_list(member)).alias("members"))
            .select("source", "blocks", F.explode(_fold(F.col("members"), level)).alias("e"))
            .select("source", "blocks", "e.unit.*", "e.p", up.alias("up"))
        )
        folded = stage(folded, f"rounded_{level}")
        done = folded.filter("up IS NOT NULL").select("source", *UNIT, "up")
        decided = done if decided is None else decided.unionByName(done)
        if most <= 1:
            # p is the same for all rows of a source
            masses = fractions.groupBy(F.col("source").alias("of")).agg((F.max("p") * F.sum("size")).alias("mass"))
            return _changed(decided, stage(masses, "masses"))
        open_rows = folded.filter("up IS NULL").withColumn("blocks", F.ceil(F.col("blocks") / BLOCK))
        level += 1


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For every row of ``docs``: source, doc_id, key, nth, size, source_size, target and copies."""
    rows = stage(units(docs), "units")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = stage(targets(sums, weights, share, most).withColumnRenamed("source", "of"), "targets")
    largest = aims.agg(F.max("n")).first()[0] or 0
    copies = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("x", copies)
    rows = rows.withColumn("base", F.floor("x").cast("int")).withColumn("p", F.col("x") - F.col("base"))
    is_open = (F.col("size") > 0) & ~_whole(F.col("p"))
    # a fraction within rounding error of one is one copy more
    plain = rows.filter(~is_open).withColumn("up", F.round("p").cast("int")).select("source", *UNIT, "up")
    ups = plain.unionByName(rounded(rows.filter(is_open).select("source", *UNIT, "p", "n"), largest)) if largest else plain
    return (
        ups.join(aims, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.when(F.col("size") > 0, F.floor(copies).cast("int") + F.col("up")).otherwise(0))
        .select("source", *UNIT, "source_size", "target", "copies")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    chosen = mixed(docs, weights, share, most).filter("copies > 0")
    # rows that repeat cannot be told apart: their copies are added up and dealt to any of them
    chosen = chosen.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("source").alias("__source")).agg(
        F.sum("copies").alias("__copies"), F.max("nth").alias("__last")
    )
    chosen = stage(chosen, "chosen")
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & (F.col("__own") == F.col("__key"))
        & F.col("source").eqNullSafe(F.col("__source"))
    )
    rows = docs.withColumn("__own", text_key())
    once = rows.join(chosen.filter("__last = 1"), same).withColumn("__n", F.col("__copies"))
    again = chosen.filter("__last > 1")
    columns = [*docs.columns, "__n"]
    if not again.isEmpty():
        place = F.row_number().over(Window.partitionBy("__id", "__key", "__source").orderBy("lang", "n_chars"))
        several = rows.join(again, same).withColumn("__place", place).filter("__place = 1").withColumn("__n", F.col("__copies"))
        once = once.select(*columns).unionByName(several.select(*columns))
    return once.select(*columns).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))).alias("__")).drop("__")
