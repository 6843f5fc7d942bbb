"""Mixing sources to target weights by Pfair scheduling.

Block i of a source with share w of the mix may not start before slot floor(i / w) and must be done by slot ceil((i + 1) / w),
counted over the whole mix; each slot goes to the released block with the earliest deadline (ties: source order). So after any
number of slots each source is within less than one block of its share, and every block is placed exactly once. Shares are
whole numbers out of a power of two, the largest with which products of slots and shares fit 64 bits; a rounded share moves a
source by less than a hundredth of a block in 2 ** 28 slots.

The schedule is cut into periods that are computed apart from one another. For that it must be known which blocks are done at
the start of a period. At slot T every block that is due by T is done, and no block that is released at T or later. Of the
others, at most one for each source, let Q(T) be the number that is still waiting: ceil(w T) summed over the sources, less T.
Those with the latest deadlines wait, taken in turn as long as, for every slot t < T, no more than Q(t) of them were released
before t (more were not waiting then). That is what earliest deadline first leaves, without having run it up to T: each period
looks at its own slots for the smallest Q, and the minima of periods are carried along each source by a window.

A source's rows are taken in the order of the MD5 of their id, ``BLOCK`` rows for each block. The mix ends when every row
of every source has had its turn; sources that would be through earlier start over as often as their share asks. With
``max_epochs`` no row comes more often than that, and the other sources get the freed share (``shares_reached`` tells the
outcome). Nothing is dropped. Without given weights a source weighs its row count to the power
``POWER``.

A row's number in its source is its number in a chunk of the hash range plus the sizes of the chunks before it, so a source
with most rows is as many chunks as it needs; prefix sums go in two levels. What is held at once is one row with all sources
and, for each period, its slots and sources; a period has as many slots as there are sources at least.

Edge cases: a null source is a source of its own. Null ids are ordered as the text ``null``. Rows with one id follow one
another, ordered by a hash of all columns. Given weights for absent sources are left out; sources without a given weight, or
with one that is not above zero, are an error. An empty table gives an empty one. Other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col
from tabulens.session import materialized

#: Slots of a period, or the number of sources if that is more.
PERIOD = 256
BLOCK = 16
#: A customary limit for callers that want one.
MAX_EPOCHS = 4
POWER = 0.7
CHUNK_ROWS = 2_000
#: The table of sources is broadcast up to this many rows, joined by a shuffle beyond.
BROADCAST_SOURCES = 5_000
#: So is the table of blocks up to this many slots.
BROADCAST_SLOTS = 100_000

_HEX = 16


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("null"))


def targets(docs: DataFrame, weights: Mapping[str | None, float] | None, source: str) -> DataFrame:
    """One row for each source: src, n (rows), w (weight)."""
    counts = docs.groupBy(source_key(source).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        given = [("null" if k is None else f"={k}", float(v)) for k, v in weights.items()]
        counts = counts.join(F.broadcast(docs.sparkSession.createDataFrame(given, "src string, w double")), "src", "left")
        counts = counts.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no weight above zero for source "), F.col("src")))))
    return materialized(counts, "weights")


def limited(counts: DataFrame, block: int, max_epochs: int | None) -> DataFrame:
    """Weights with which no source needs more than ``max_epochs`` passes before every row has had its turn; what that frees goes to the others in proportion."""
    if max_epochs is None:
        return counts
    longest = counts.agg(F.max(F.ceil(F.col("n") / block) / F.col("w"))).first()[0]
    return counts.withColumn("w", F.least(F.col("w"), F.lit(max_epochs) * F.col("n") / block / F.lit(longest)))


def shares_reached(rows: DataFrame, source: str = "source") -> DataFrame:
    """src, rows and share of the mix that each source has in what ``mixed`` or ``mix`` returned."""
    counts = rows.groupBy(source_key(source).alias("src")).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(0))))


def _div(x: Column, y: Column | int) -> Column:
    """Whole division of whole numbers that are not negative."""
    return F.call_function("div", x, F.lit(y).cast("long") if isinstance(y, int) else y)


def _ceil_div(x: Column, y: Column | int) -> Column:
    return _div(x + y - 1, y)


def whole_shares(counts: DataFrame, block: int, period: int) -> tuple[DataFrame, int, int, int]:
    """The sources in one row (``v``: src, n, a in order of src), the sum of their shares a, the slots of a period, and how many periods there are."""
    top = counts.agg(F.count("*").alias("k"), F.sum("w").alias("w"), F.max(F.ceil(F.col("n") / block) / F.col("w")).alias("x")).first()
    if not top["k"]:
        return counts.select(F.array().alias("v")).where("false"), 0, 0, 0
    slots, length = math.ceil(top["x"] * top["w"]) + top["k"] + 2, max(period, top["k"])
    bits = 61 - math.ceil(math.log2(slots + length))
    share = F.greatest(F.lit(1).cast("long"), F.round(F.col("w") / F.lit(top["w"]) * F.lit(float(1 << bits))).cast("long"))
    line = counts.select("src", "n", share.alias("a")).agg(F.array_sort(F.collect_list(F.struct("src", "n", "a"))).alias("v"))
    line = materialized(line, "shares")
    total = line.select(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["a"])).first()[0]
    return line, total, length, -(-slots // length)


def _by_source(order_by: str) -> Window:
    return Window.partitionBy("src").orderBy(order_by)


def waiting(line: DataFrame, total: int, periods: int, length: int) -> DataFrame:
    """One row for each source and period p: src, n, a, and ``first`` and ``done``, its blocks done when the period starts and ends."""
    spark = line.sparkSession
    every = spark.range(periods).select(F.col("id").alias("p"), F.lit(0).alias("one")).repartition(max(1, min(periods, spark.sparkContext.defaultParallelism * 4)), "p")
    every = every.join(F.broadcast(line.withColumn("one", F.lit(0))), "one")
    begin, end = F.col("p") * length, (F.col("p") + 1) * length

    def backlog(t: Column) -> Column:
        return F.aggregate("v", -t, lambda s, x: s + _ceil_div(x["a"] * t, total))

    every = every.withColumn("q", F.transform(F.sequence(begin + 1, end), backlog)).withColumn("least", F.array_min("q"))
    # The last block that each source has released before the period ends.
    each = every.select("p", "q", "least", F.explode("v").alias("x")).select("p", "q", "least", "x.*")
    each = each.withColumn("i", _ceil_div(F.col("a") * end, total) - 1)
    each = each.withColumn("r", _div(F.col("i") * total, F.col("a")))
    here = F.col("r") >= begin
    after = F.array_min(F.slice("q", F.when(here, F.col("r") - begin + 1).otherwise(F.lit(1)).cast("int"), F.lit(length)))
    each = each.select("p", "src", "n", "a", "i", "r", here.cast("int").alias("here"), F.when(here, after).otherwise(F.col("least")).alias("g"))
    # The smallest number of waiting blocks in the slots from a block's release on.
    each = each.withColumn("run", F.sum("here").over(_by_source("p").rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("src", "run").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("g", F.min("g").over(since)).withColumn("open", (F.col("a") * end) % total != 0)
    due = _ceil_div((F.col("i") + 1) * total, F.col("a"))
    at_end = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct(due.alias("due"), "src", "n", "a", "i", "r", "g", "open"))).alias("s"))
    at_end = at_end.withColumn("late", F.reverse(F.filter("s", lambda x: x["open"])))
    start = F.struct(F.transform("late", lambda x: F.struct(x["r"].alias("r"), x["g"].alias("room"))).alias("rooms"), F.array().cast("array<string>").alias("wait"))

    def take(now: Column, x: Column) -> Column:
        full = F.exists(now["rooms"], lambda k: (k["r"] >= x["r"]) & (k["room"] <= 0))
        rooms = F.transform(now["rooms"], lambda k: F.struct(k["r"].alias("r"), F.when(k["r"] >= x["r"], k["room"] - 1).otherwise(k["room"]).alias("room")))
        return F.when(full, now).otherwise(F.struct(rooms.alias("rooms"), F.concat(now["wait"], F.array(x["src"])).alias("wait")))

    at_end = at_end.select("p", "s", F.aggregate("late", start, take, lambda now: now["wait"]).alias("wait"))
    done = at_end.select("p", "wait", F.explode("s").alias("x")).select("p", "x.src", "x.n", "x.a", (F.col("x.i") + 1 - F.array_contains("wait", F.col("x.src")).cast("long")).alias("done"))
    return done.withColumn("first", F.lag("done", 1, 0).over(_by_source("p")))


def earliest_deadline_first(table: DataFrame, total: int, length: int) -> DataFrame:
    """For each source and period of ``waiting`` with a block in it: p, src, n, first, and ``slots``, the slots its blocks get in order.

    The sources of a period are one row here: at most one for each slot of the period, as those without a block are left out.
    """
    table = table.withColumn("k", F.col("done") - F.col("first")).where("k > 0")
    line = table.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("src", "a", "n", "first", "k"))).alias("s"))
    state = F.struct(F.transform("s", lambda x: x["first"]).alias("next"), F.array().cast("array<int>").alias("order"))

    def step(now: Column, t: Column) -> Column:
        def offer(x: Column, i: Column) -> Column:
            block = now["next"][i]
            released = (block < x["first"] + x["k"]) & (_div(block * total, x["a"]) <= t)
            return F.when(released, F.struct(_ceil_div((block + 1) * total, x["a"]).alias("deadline"), i.alias("i")))

        def taken(best: Column) -> Column:
            following = F.transform(now["next"], lambda d, i: F.when(i == best, d + 1).otherwise(d))
            return F.struct(following.alias("next"), F.concat(now["order"], F.array(best)).alias("order"))

        # As an element of an array the choice is worked out once for the slot.
        best = F.array_min(F.filter(F.transform("s", offer), lambda o: o.isNotNull()))["i"]
        return F.get(F.transform(F.array(best), taken), F.lit(0))

    begin = F.col("p") * length
    order = F.aggregate(F.sequence(begin, begin + length - 1), state, step, lambda now: now["order"])
    placed = line.select("p", "s", order.alias("order")).select("p", "order", F.posexplode("s").alias("i", "x"))
    mine = F.filter(F.transform("order", lambda o, slot: F.when(o == F.col("i"), F.col("p") * length + slot)), lambda slot: slot.isNotNull())
    return placed.select("p", "x.src", "x.n", "x.first", mine.alias("slots"))


def schedule(counts: DataFrame, period: int, block: int) -> DataFrame:
    """One row for each block of each source (src, n, w): src, block, slot, last (the block with the last row of the first pass)."""
    line, total, length, periods = whole_shares(counts, block, period)
    if not periods:
        return counts.sparkSession.createDataFrame([], "src string, block long, slot long, last long")
    turns = earliest_deadline_first(waiting(line, total, periods, length), total, length)
    placed = turns.select("src", "n", "first", F.posexplode("slots").alias("j", "slot"))
    return placed.select("src", (F.col("first") + F.col("j")).alias("block"), "slot", (F.ceil(F.col("n") / block) - 1).cast("long").alias("last"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", period: int = PERIOD, block: int = BLOCK, max_epochs: int | None = None) -> DataFrame:
    """The rows with ``__epoch``, ``__slot`` (their block's turn) and ``__position`` in the mix."""
    counts = limited(targets(docs, weights, source), block, max_epochs)
    rows = counts.agg(F.sum("n")).first()[0]
    places = materialized(schedule(counts, period, block), "places")
    # The mix ends with the last slot that a first pass over any source needs.
    end = (places.where("block = last").agg(F.max("slot")).first()[0] or 0) + 1
    places = places.where(F.col("slot") < end).select(F.col("src").alias("__src"), F.col("block").alias("__block"), F.col("slot").alias("__slot"))
    plan = materialized(places.groupBy("__src").agg(F.count("*").alias("__blocks")).join(counts.select(F.col("src").alias("__src"), F.col("n").alias("__n")), "__src"), "plan")
    n_sources = plan.count()
    digits = max(0, math.ceil(math.log((rows or 1) / CHUNK_ROWS, _HEX))) if rows else 0
    key = F.md5(F.coalesce(col(doc_id).cast("string"), F.lit("null")))
    keyed = docs.withColumns({"__src": source_key(source), "__key": key})
    keyed = keyed.withColumns({"__chunk": F.substring("__key", 1, digits), "__part": F.substring("__key", 1, digits // 2)})
    sizes = materialized(keyed.groupBy("__src", "__part", "__chunk").agg(F.count("*").alias("c")), "chunks")
    parts = sizes.groupBy("__src", "__part").agg(F.sum("c").alias("c"))
    outer = Window.partitionBy("__src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__src", "__part", F.coalesce(F.sum("c").over(outer), F.lit(0)).alias("p"))
    inner = Window.partitionBy("__src", "__part").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.withColumn("q", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(parts, ["__src", "__part"]).select("__src", "__chunk", (F.col("p") + F.col("q")).alias("__before"))
    chunks = chunks.join(F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan, "__src")
    within = Window.partitionBy("__src", "__chunk").orderBy("__key", col(doc_id), F.xxhash64(*(col(c) for c in docs.columns)))
    ranked = keyed.withColumn("__k", F.row_number().over(within) - 1).join(chunks, ["__src", "__chunk"]).withColumn("__k", F.col("__k") + F.col("__before"))
    epochs = F.floor((F.col("__blocks") * block - 1 - F.col("__k")) / F.col("__n"))
    if max_epochs is not None:
        epochs = F.least(epochs, F.lit(max_epochs - 1))
    turns = ranked.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs.cast("long"))))
    item = F.col("__k") + F.col("__epoch") * F.col("__n")
    turns = turns.withColumns({"__block": F.floor(item / block).cast("long"), "__at": item % block})
    placed = turns.join(F.broadcast(places) if end <= BROADCAST_SLOTS else places, ["__src", "__block"]).withColumn("__position", F.col("__slot") * block + F.col("__at"))
    return placed.select(*(col(c) for c in docs.columns), "__epoch", "__slot", "__position")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", max_epochs: int | None = None) -> DataFrame:
    """The rows in the order of the mix (within and across the written files), repeated as it asks; columns as they were."""
    ordered = mixed(docs, weights, source, doc_id, max_epochs=max_epochs).repartitionByRange("__position").sortWithinPartitions("__position")
    return ordered.select(*(col(c) for c in docs.columns))
