"""Exact quantiles in three scans, whatever the number of rows, columns and groups.

The first scan sketches every column of every group (bounded, mergeable) and takes from it, for each wanted quantile, a value
a little below and one a little above: a bracket. The second counts how many values lie before and inside each bracket, which
proves that the wanted ranks are inside. The third fetches the values inside, counted by value. A bracket with more than
``FEW`` rows between its ends is narrowed by a sketch of its inside and another count before that, as long as this leaves fewer,
so no task holds more than that many values of a group. The ends themselves are one value each, however many rows have it. A
bracket whose ends are equal needs no values at all. Tables of any size go this one way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabulens.functions.nulls import number, quoted
from tabulens.session import materialized

#: Accuracy of the sketches: their ranks are off by less than rows / ACCURACY. Brackets leave twice that.
ACCURACY = 1000
MARGIN = 2 / ACCURACY
#: Distinct values of a bracket that may be fetched.
FEW = 200_000
#: Parts that the inside of a bracket is cut into to narrow it, and how often at most.
PARTS = 100
ROUNDS = 6
#: Columns that go into one scan.
BATCH = 40
#: Groups whose brackets are sent to all tasks; more are joined by a shuffle.
SENT_GROUPS = 10_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., column, quantiles)``: linear interpolation, NULL and NaN ignored; NULL where a group has no value."""
    parts = [_of_batch(df, cols[i : i + BATCH], list(probs), list(by)) for i in range(0, len(cols), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def collect_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """One small row per column on the driver, to be used as literals."""
    found = {r["column"]: r["quantiles"] for r in exact_quantiles(df, cols, probs).collect()} if cols else {}
    return {c: found.get(c) for c in cols}


def _of_batch(df: DataFrame, cols: Sequence[str], probs: list[float], by: list[str]) -> DataFrame:
    keys = [f"g{i}" for i in range(len(by))]
    # Adding 0.0 turns -0.0 into 0.0.
    rows = df.select(*[quoted(b).alias(k) for b, k in zip(by, keys)], *[(number(df, c) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    slots = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    state = _counted(rows, keys, _sketched(rows, keys, len(cols), probs), slots, probs)
    inside = _rows_to_narrow(state, slots)
    for _ in range(ROUNDS):
        if not inside:
            break
        state = _counted(rows, keys, _narrowed(rows, keys, state, slots, probs), slots, probs)
        before, inside = inside, _rows_to_narrow(state, slots)
        if inside >= before:
            break
    return _read_off(rows, keys, state, slots, probs, cols, by)


def _kept(found: DataFrame, keys: list[str]) -> DataFrame | Row:
    """One row on the driver, or a written table of one row for each group."""
    return materialized(found, "brackets") if keys else found.first()


def _attached(rows: DataFrame, keys: list[str], state: DataFrame | Row) -> DataFrame:
    """The rows with what is known of their group: as literals where there is one group."""
    if isinstance(state, Row):
        return rows.select("*", *[F.lit(v).cast("long" if c[0] in "nbmv" else "double").alias(c) for c, v in state.asDict().items()])
    known = state.withColumnsRenamed({k: f"own_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys])
    sent = F.broadcast(known) if state.count() <= SENT_GROUPS else known
    return rows.join(sent, same).drop(*[f"own_{k}" for k in keys])


def _at(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(float(p))


def _sketched(rows: DataFrame, keys: list[str], n_cols: int, probs: list[float]) -> DataFrame | Row:
    ends = [min(1.0, max(0.0, e)) for p in probs for e in (p - MARGIN, p + MARGIN)]
    aggs = [x for i in range(n_cols) for x in (F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", ends, ACCURACY).alias(f"e{i}"))]
    found = rows.groupBy(*keys).agg(*aggs)
    picked = [F.get(f"e{i}", F.lit(2 * j + up)).alias(f"{end}{i}_{j}") for i in range(n_cols) for j in range(len(probs)) for up, end in enumerate(("lo", "hi"))]
    return _kept(found.select(*keys, *[f"n{i}" for i in range(n_cols)], *picked), keys)


def _counted(rows: DataFrame, keys: list[str], state: DataFrame | Row, slots: list[tuple[int, int]], probs: list[float]) -> DataFrame | Row:
    """Adds b (rows before the bracket), m (rows in it) and v (those between its ends); a bracket without its ranks becomes the whole column."""
    aggs = []
    for i, j in slots:
        x, lo, hi = F.col(f"x{i}"), F.col(f"lo{i}_{j}"), F.col(f"hi{i}_{j}")
        aggs += [F.count_if(x < lo).alias(f"b{i}_{j}"), F.count_if(x.between(lo, hi)).alias(f"m{i}_{j}"), F.count_if((x > lo) & (x < hi)).alias(f"v{i}_{j}")]
    given = _attached(rows, keys, state)
    if isinstance(state, Row):
        # What is known already stays out of the aggregation, whose code would become too long to be compiled.
        found = _attached(given.agg(*aggs), keys, state)
    else:
        found = given.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in state.columns if c not in keys], *aggs)
    out = []
    for i, j in slots:
        n, b, m = F.col(f"n{i}"), F.col(f"b{i}_{j}"), F.col(f"m{i}_{j}")
        at = _at(n, probs[j])
        proven = (b <= F.floor(at)) & (F.ceil(at) < b + m)
        every = {"lo": F.lit(-math.inf), "hi": F.lit(math.inf), "b": F.lit(0).cast("long"), "m": n, "v": n}
        out += [F.when(proven | (n == 0), F.col(f"{c}{i}_{j}")).otherwise(whole).alias(f"{c}{i}_{j}") for c, whole in every.items()]
    return _kept(found.select(*keys, *[f"n{i}" for i in sorted({i for i, _ in slots})], *out), keys)


def _rows_to_narrow(state: DataFrame | Row, slots: list[tuple[int, int]]) -> int:
    """Rows between the ends of the brackets that hold more than ``FEW`` of them."""
    if isinstance(state, Row):
        return sum(state[f"v{i}_{j}"] for i, j in slots if state[f"n{i}"] and state[f"v{i}_{j}"] > FEW)
    many = [F.when(F.col(f"v{i}_{j}") > FEW, F.col(f"v{i}_{j}")).otherwise(F.lit(0)).cast("double") for i, j in slots]
    return int(state.agg(F.sum(reduce(lambda a, b: a + b, many))).first()[0] or 0)


def _narrowed(rows: DataFrame, keys: list[str], state: DataFrame | Row, slots: list[tuple[int, int]], probs: list[float]) -> DataFrame | Row:
    """Brackets from a sketch of the values inside the last ones; those with few stay."""
    ends = [k / PARTS for k in range(PARTS + 1)]
    aggs, picked = [F.any_value(f"n{i}").alias(f"n{i}") for i in sorted({i for i, _ in slots})], []
    for i, j in slots:
        s = f"{i}_{j}"
        if isinstance(state, Row) and state[f"v{s}"] <= FEW:
            picked += [F.lit(state[f"{c}{s}"]).cast("double").alias(f"{c}{s}") for c in ("lo", "hi")]
            continue
        inside = F.when((F.col(f"v{s}") > FEW) & F.col(f"x{i}").between(F.col(f"lo{s}"), F.col(f"hi{s}")), F.col(f"x{i}"))
        aggs += [F.percentile_approx(inside, ends, ACCURACY).alias(f"e{s}"), *[F.any_value(f"{c}{s}").alias(f"{c}{s}") for c in ("lo", "hi", "b", "m", "v")]]
        share = (_at(F.col(f"n{i}"), probs[j]) - F.col(f"b{s}")) / F.col(f"m{s}")
        below = F.greatest(F.floor((share - MARGIN) * PARTS), F.lit(0)).cast("int")
        above = F.least(F.ceil((share + MARGIN) * PARTS) + 1, F.lit(PARTS)).cast("int")
        picked += [F.when(F.col(f"v{s}") > FEW, F.get(f"e{s}", at)).otherwise(F.col(f"{c}{s}")).alias(f"{c}{s}") for c, at in (("lo", below), ("hi", above))]
    found = _attached(rows, keys, state).groupBy(*keys).agg(*aggs)
    return _kept(found.select(*keys, *[f"n{i}" for i in sorted({i for i, _ in slots})], *picked), keys)


def _read_off(
    rows: DataFrame, keys: list[str], state: DataFrame | Row, slots: list[tuple[int, int]], probs: list[float], cols: Sequence[str], by: list[str]
) -> DataFrame:
    spark = rows.sparkSession
    table = _attached(spark.range(1).select(), keys, state) if isinstance(state, Row) else state
    each = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(probs[j])).alias("p"), *[F.col(f"{c}{i}_{j}").alias(c) for c in ("lo", "hi", "b")], F.col(f"n{i}").alias("n"))
        for i, j in slots
    ])
    wanted = table.select(*keys, F.explode(each).alias("s")).select(*keys, "s.*").withColumn("at", (F.col("n") - 1) * F.col("p"))

    open_ = {(i, j): F.col(f"x{i}").between(F.col(f"lo{i}_{j}"), F.col(f"hi{i}_{j}")) & (F.col(f"lo{i}_{j}") < F.col(f"hi{i}_{j}")) for i, j in slots}
    held = [F.when(hit, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"x{i}").alias("v"))) for (i, j), hit in open_.items()]
    # Few rows are left when the brackets are opened for each value.
    near = _attached(rows, keys, state).where(reduce(lambda a, b: a | b, open_.values()))
    values = near.select(*keys, F.explode(F.filter(F.array(*held), lambda h: h.isNotNull())).alias("h")).select(*keys, "h.*")
    values = values.groupBy(*keys, "i", "j", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("end", F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    values = values.withColumnsRenamed({k: f"own_{k}" for k in keys} | {"i": "own_i", "j": "own_j"})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in [*keys, "i", "j"]])
    low, high = F.floor("at") - F.col("b"), F.ceil("at") - F.col("b")
    pick = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("end")), F.col("v")))
    found = wanted.join(values, same, "left").groupBy(*keys, "i", "j").agg(
        F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"), F.any_value("at").alias("at"), F.any_value("n").alias("n"), pick(low).alias("low"), pick(high).alias("high"),
    )
    equal = F.col("lo") == F.col("hi")
    found = found.withColumns({"low": F.when(equal, F.col("lo")).otherwise(F.col("low")), "high": F.when(equal, F.col("lo")).otherwise(F.col("high"))})
    part = F.col("at") - F.floor("at")
    value = F.when(part > 0, F.col("low") * (1 - part) + F.col("high") * part).otherwise(F.col("low"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("q")))), lambda s: s["q"])
    done = found.groupBy(*keys, "i").agg(F.when(F.any_value("n") > 0, ordered).alias("quantiles"))
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("i")).alias("column")
    return done.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], name, "quantiles")
