"""JSON files that are one document, cut into records by many tasks.

A file is read as text that ends at every ``}``, so no row is longer than a record, however the file is laid out, and Spark
splits it like any text. What a piece of text does to the scanner is a few numbers: whether it holds an odd number of quotes,
and how the nesting changes if it begins outside or inside a string. These are summed up within each split of a file for both
beginnings; a prefix over the splits (one row each) then says how every split begins, and with that, where records end. Pieces
between two ends are put together to one record. No value is as large as a file. The pieces are written once, as another scan
might split the files elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulens.functions.nulls import quoted
from tabulens.session import materialized

#: White space of JSON.
BLANK = " \t\r\n"
_END = "}"
_PIECE = ["_file", "_block", "_seq"]


def as_text(spark: SparkSession, paths: str | Sequence[str], base: str | None = None, **options: object) -> DataFrame:
    """Text files with their partition columns, as Spark finds them."""
    reader = spark.read.options(**options)
    return (reader if base is None else reader.option("basePath", base)).text(paths)


def _pieces(spark: SparkSession, paths: str | Sequence[str], base: str | None = None) -> DataFrame:
    rows = as_text(spark, paths, base, lineSep=_END)
    found = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"))
    # The order of the pieces of a split.
    return found.withColumn("_seq", F.monotonically_increasing_id())


def file_ends(spark: SparkSession, paths: str | Sequence[str], base: str | None = None) -> DataFrame:
    """One row for each file that holds anything: ``file``, ``first`` and ``last`` character that is not blank, ``closed``."""
    rows = _pieces(spark, paths, base).select(*_PIECE, "_size", "value").withColumn("t", F.btrim("value", F.lit(BLANK)))
    place = F.struct("_block", "_seq")
    found = rows.groupBy("_file").agg(
        F.min_by(F.substring("t", 1, 1), place).alias("first"), F.max_by(F.right("t", F.lit(1)), place).alias("last"),
        F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"), F.any_value("_size").alias("size"), F.max(F.length("t")).alias("longest"),
    )
    # All pieces but the last are followed by the sign that ends them; whether that one is shows in the size.
    closed = F.col("bytes") + F.col("n") - 1 != F.col("size")
    end = lambda c: F.when(F.col(c) == "", F.lit(_END)).otherwise(F.col(c))
    found = found.where((F.col("longest") > 0) | (F.col("n") > 1) | closed)
    return found.select(F.col("_file").alias("file"), end("first").alias("first"), F.when(closed, F.lit(_END)).otherwise(end("last")).alias("last"), closed.alias("closed"))


def _brackets(text: Column) -> Column:
    """The brackets of a text that begins outside a string; strings, the last one open, do not count."""
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|$)', ""), r"[^\[\]{}]", "")


def _change(brackets: Column) -> Column:
    opening = F.length(F.regexp_replace(brackets, r"[\]}]", ""))
    return (opening * 2 - F.length(brackets)).cast("long")


def _scanned(pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """The pieces with ``q`` (odd number of quotes), ``b0`` and ``b1`` (brackets if begun outside, inside a string), and their file's first character."""
    plain = F.regexp_replace("value", r"\\[\s\S]", "")
    rows = pieces.withColumn("_plain", plain).withColumn("q", (F.length("_plain") - F.length(F.replace("_plain", F.lit('"'), F.lit("")))) % 2)
    rows = rows.withColumn("b0", _brackets(F.col("_plain"))).withColumn("b1", _brackets(F.regexp_replace("_plain", r'^[^"]*("|$)', ""))).drop("_plain")
    # One row for each file that may be a document: the listing of the files is held by the driver anyway.
    return rows.join(F.broadcast(ends.select(F.col("file").alias("_file"), (F.col("first") == "[").cast("int").alias("base"), "closed")), "_file")


def _followed(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Along each split: ``s`` (begins inside a string), ``d`` (change of depth) and ``depth`` before the piece, from the split's beginning on.

    Without ``starts`` a split begins outside a string at depth 0; ``other`` is then the change of depth if it began inside one.
    """
    before = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    if starts is not None:
        rows = rows.join(starts, ["_file", "_block"])
    begin = F.lit(0) if starts is None else F.col("start_s")
    local = F.coalesce(F.sum("q").over(before), F.lit(0))
    rows = rows.withColumn("s", (begin + local) % 2)

    def change(inside: Column) -> Column:
        closes = F.when((inside + F.col("q")) % 2 == 0, F.lit(1)).otherwise(F.lit(0))
        return _change(F.when(inside == 0, F.col("b0")).otherwise(F.col("b1"))) - closes

    rows = rows.withColumn("d", change(F.col("s")))
    if starts is None:
        return rows.withColumn("other", change(1 - F.col("s")))
    return rows.withColumn("depth", F.col("start_depth") + F.coalesce(F.sum("d").over(before), F.lit(0)))


def _starts(rows: DataFrame) -> DataFrame:
    """One row for each split: how it begins, from what the splits before it do."""
    sums = _followed(rows, None).groupBy("_file", "_block").agg(F.sum("q").alias("q"), F.sum("d").alias("d"), F.sum("other").alias("other"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start_s", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("own", F.when(F.col("start_s") == 0, F.col("d")).otherwise(F.col("other")))
    return sums.select("_file", "_block", "start_s", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start_depth"))


def _ends_record(base: str = "base") -> Column:
    return ((F.col("s") + F.col("q")) % 2 == 0) & (F.col("depth") + F.col("d") == F.col(base))


def _single(rows: DataFrame) -> DataFrame:
    """Per file: ``hits``, the places where the nesting is left, and ``final``, the depth at the end; and per split its records."""
    brackets = F.when(F.col("s") == 0, F.col("b0")).otherwise(F.col("b1"))
    brackets = F.concat(brackets, F.when((F.col("s") + F.col("q")) % 2 == 0, F.lit(_END)).otherwise(F.lit("")))
    walk = F.aggregate(
        F.split(brackets, ""), F.struct(F.col("depth").alias("d"), F.lit(0).alias("n")),
        lambda now, x: F.struct(
            (now["d"] + F.when(x.isin("[", "{"), F.lit(1)).when(x == "", F.lit(0)).otherwise(F.lit(-1))).alias("d"),
            (now["n"] + F.when(x.isin("]", "}") & (now["d"] <= 1), F.lit(1)).otherwise(F.lit(0))).alias("n"),
        ),
        lambda now: now["n"],
    )
    return rows.groupBy("_file", "_block").agg(
        F.sum(walk.cast("long")).alias("hits"), F.sum(_ends_record().cast("long")).alias("records"),
        F.max_by(F.col("depth") + F.col("d"), "_seq").alias("final"), F.any_value("closed").alias("closed"), F.any_value("base").alias("base"),
    )


def documents_of(spark: SparkSession, ends: DataFrame, base: str | None) -> tuple[list[str], DataFrame, DataFrame]:
    """Of the files of ``ends``, those that are one value from the first character to the last; all pieces; and how their splits begin."""
    files = [plain_path(r["file"]) for r in ends.select("file").collect()]
    rows = materialized(_scanned(_pieces(spark, files, base), ends), "pieces")
    starts = materialized(_starts(rows), "splits")
    splits = materialized(_single(_followed(rows, starts)).join(starts, ["_file", "_block"]), "splits")
    # The sign that no piece of a file that is not closed has at its end was counted as one bracket too many.
    last = splits.groupBy("_file").agg(F.sum("hits").alias("hits"), F.max_by("final", "_block").alias("final"), F.any_value("closed").alias("closed"))
    open_ = ~F.col("closed")
    single = last.where((F.col("final") + open_.cast("int") == 0) & (F.col("hits") - open_.cast("int") == 1))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start_record", F.coalesce(F.sum("records").over(before), F.lit(0))).select("_file", "_block", "start_s", "start_depth", "start_record")
    return sorted(plain_path(r["_file"]) for r in single.select("_file").collect()), rows, starts


def records(pieces: DataFrame, starts: DataFrame, files: Sequence[str]) -> DataFrame:
    """``value``: one record a row, without line breaks, and the partition columns of its file."""
    inner = {"value", "_size", "q", "b0", "b1", "base", "closed", *_PIECE}
    own = [c for c in pieces.columns if c not in inner]
    named = [r["_file"] for r in pieces.select("_file").distinct().collect() if plain_path(r["_file"]) in set(files)]
    rows = _followed(pieces.where(F.col("_file").isin(named)), starts)
    before = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_record", F.col("start_record") + F.coalesce(F.sum(_ends_record().cast("long")).over(before), F.lit(0)))
    whole = rows.groupBy("_file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_seq", "value"))).alias("parts"), F.any_value("base").alias("base"), F.any_value("closed").alias("closed"),
        *[F.any_value(quoted(c)).alias(c) for c in own],
    )
    final = rows.groupBy("_file").agg(F.max("_record").alias("_final"))
    whole = whole.join(F.broadcast(final), "_file").withColumn("last", F.col("_record") == F.col("_final"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), _END)
    # The closing sign is there after every record, and after the last text of a file if that ends with it.
    whole = whole.withColumn("t", F.concat(text, F.when(F.col("last") & ~F.col("closed"), F.lit("")).otherwise(F.lit(_END))))
    bare = F.regexp_replace("t", r"^\s*[\[,]", "")
    bare = F.when(F.col("last"), F.regexp_replace(bare, r"\]\s*$", "")).otherwise(bare)
    found = whole.withColumn("t", F.btrim(F.when(F.col("base") == 0, F.col("t")).otherwise(bare), F.lit(BLANK))).where("t != ''")
    # Between two records there may be values that are none; a record by itself is not read twice.
    several = F.when((F.col("base") == 1) & ~F.startswith("t", F.lit("{")), F.from_json(F.concat(F.lit("["), "t", F.lit("]")), "array<string>"))
    each = found.select(*[quoted(c) for c in own], F.explode(F.coalesce(several, F.array("t"))).alias("value"))
    return each.withColumn("value", F.regexp_replace("value", r"[\r\n]+", " "))


def plain_path(uri: str) -> str:
    """A path as readers take it: file URIs come percent-encoded."""
    return unquote(uri)
