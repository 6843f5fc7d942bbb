"""Readers, chunking and sinks (S)."""

from pyspark.sql import functions as F

from queries.common import GAPPY_PART_SQL, gappy_part, query, table, union_sql
from tabulens.operators.clean import impute
from tabulens.operators.profile import sample_values
from tabulens.session import scratch_path
from tabulens.sources.chunking import chunk_text
from tabulens.sources.readers import (
    bad_line_count,
    decode_text,
    flatten_structs,
    head_tail,
    load_dataset,
    preview,
    read_any,
    read_csv,
    read_json,
    save_dataset,
    unwrap_envelope,
)

_EVENTS = ("event_id", "user_id", "event_type", "value")
_EVENTS_SQL = "SELECT event_id, user_id, event_type, value FROM events"
_EVENTS_SCHEMA = "event_id long, user_id long, event_type string, value double"
_ARRAY_ROWS = 5000


@query("s01_read_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s01(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path).select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), "c_acctbal", "c_mktsegment"
    )


@query("s02_read_json_array", _EVENTS_SQL)
def s02(spark, sf):
    path = scratch_path(spark, "arrays")
    # Files of one array each, of bounded length.
    part = F.floor(F.col("event_id") / _ARRAY_ROWS).alias("part")
    arrays = table(spark, sf, "events").groupBy(part).agg(F.to_json(F.collect_list(F.struct(*_EVENTS))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return read_json(spark, path).select(*_EVENTS)


@query(
    "s03_flatten_structs",
    "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS props_k, user_id AS who_id, event_type AS who_did_type FROM events",
)
def s03(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "k int").alias("props"),
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("type")).alias("did")).alias("who"),
    )
    return flatten_structs(nested)


@query("s04_read_json_lines", _EVENTS_SQL)
def s04(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "events").select(*_EVENTS).write.json(path)
    return read_json(spark, path).select(*_EVENTS)


def _partly_bad(spark, sf):
    path = scratch_path(spark, "bad")
    line = F.when(F.col("event_id") % 9 == 0, F.lit('{"event_id": 1, "user')).otherwise(F.to_json(F.struct(*_EVENTS)))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return path


@query("s05_skip_bad_lines", _EVENTS_SQL + " WHERE event_id % 9 <> 0")
def s05(spark, sf):
    return read_json(spark, _partly_bad(spark, sf), lines=True, on_bad="skip", schema=_EVENTS_SCHEMA)


@query(
    "s05_bad_line_count",
    "SELECT count(*) FILTER (event_id % 9 <> 0) AS good_lines, count(*) FILTER (event_id % 9 = 0) AS bad_lines FROM events",
)
def s05_count(spark, sf):
    return bad_line_count(spark, _partly_bad(spark, sf))


@query("s05_bad_first_line", _EVENTS_SQL)
def s05_first(spark, sf):
    """Every file starts with a line that is no record."""
    path = scratch_path(spark, "first")
    rows = table(spark, sf, "events").select((F.col("event_id") % 8).alias("p"), "event_id", F.to_json(F.struct(*_EVENTS)).alias("value"))
    bad = spark.range(8).select(F.col("id").alias("p"), F.lit(-1).cast("long").alias("event_id"), F.lit("[1]").alias("value"))
    rows.unionByName(bad).repartition(8, "p").sortWithinPartitions("p", "event_id").select("value").write.text(path)
    return read_json(spark, path, on_bad="skip").select(*_EVENTS)


@query(
    "s05_keep_bad_lines",
    """SELECT CASE WHEN event_id % 9 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 9 = 0 THEN '{"event_id": 1, "user' END AS bad FROM events""",
)
def s05_keep(spark, sf):
    schema = f"{_EVENTS_SCHEMA}, _corrupt_record string"
    return read_json(spark, _partly_bad(spark, sf), on_bad="keep", schema=schema).selectExpr("event_id", "_corrupt_record AS bad")


@query("s02_read_json_mixed_folder", _EVENTS_SQL)
def s02_mixed(spark, sf):
    """Some files hold lines, some one array."""
    path = scratch_path(spark, "mixed")
    events = table(spark, sf, "events")
    lines = events.where("event_id % 3 > 0").select(F.to_json(F.struct(*_EVENTS)).alias("value"), F.lit(-1).alias("part"))
    lines.write.partitionBy("part").text(path)
    part = F.floor(F.col("event_id") / _ARRAY_ROWS).alias("part")
    arrays = events.where("event_id % 3 = 0").groupBy(part).agg(F.to_json(F.collect_list(F.struct(*_EVENTS))).alias("value"))
    arrays.write.mode("append").partitionBy("part").text(path)
    return read_json(spark, path).select(*_EVENTS)


@query("s02_read_json_partitions", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 11 <> 0")
def s02_partitions(spark, sf):
    """Folders name the kind of event; some files hold lines, one in eleven bad, some one array."""
    path = scratch_path(spark, "kinds")
    body = ("event_id", "user_id", "value")
    events = table(spark, sf, "events").where("event_id % 11 <> 0 OR event_id % 2 = 0")
    line = F.when(F.col("event_id") % 11 == 0, F.lit('{"event_id": 1, "user')).otherwise(F.to_json(F.struct(*body)))
    events.where("event_id % 2 = 0").select("event_type", line.alias("value")).write.partitionBy("event_type").text(path)
    part = F.floor(F.col("event_id") / _ARRAY_ROWS)
    arrays = events.where("event_id % 2 = 1").groupBy("event_type", part).agg(F.to_json(F.collect_list(F.struct(*body))).alias("value"))
    arrays.select("event_type", "value").repartition(2, "event_type").write.option("maxRecordsPerFile", 1).mode("append").partitionBy("event_type").text(path)
    return read_json(spark, path, on_bad="skip").select(*_EVENTS)


@query("s06_unwrap_envelope", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s06(spark, sf):
    rows = F.collect_list(F.struct("o_orderkey", "o_custkey", "o_totalprice"))
    envelopes = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(rows.alias("data"))
    return unwrap_envelope(envelopes.withColumn("dataset_name", F.lit("orders")), "data")


@query("s07_chunk_text_recursive")
def s07(spark, sf):
    return chunk_text(table(spark, sf, "documents"), "text", ["doc_id"])


@query(
    "s07_chunk_cover",
    r"""
    SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, TRUE AS within_size
    FROM documents WHERE regexp_matches(text, '\S')
    """,
)
def s07_cover(spark, sf):
    """All words of a text are in its chunks, and no chunk is too long."""
    chunks = chunk_text(table(spark, sf, "documents"), "text", ["doc_id"])
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\S+)"))))
    return (
        chunks.select("doc_id", (F.col("length") <= 1000).alias("fits"), words.alias("word"))
        .groupBy("doc_id", "word").agg(F.bool_and("fits").alias("fits"))
        .groupBy("doc_id").agg(F.count("*").alias("words"), F.bool_and("fits").alias("within_size"))
    )


@query(
    "s08_chunk_text_fixed",
    r"""
    SELECT doc_id, CAST(start / 1000 AS INT) AS chunk_no, substring(text, start + 1, 1000) AS content,
           CAST(length(substring(text, start + 1, 1000)) AS INT) AS length
    FROM (SELECT doc_id, text, CAST(unnest(range(0, greatest(length(text), 1), 1000)) AS BIGINT) AS start FROM documents)
    WHERE trim(substring(text, start + 1, 1000), ' ' || chr(9) || chr(10) || chr(13)) <> ''
    """,
)
def s08(spark, sf):
    return chunk_text(table(spark, sf, "documents"), "text", ["doc_id"], mode="fixed")


@query("s09_decode_text", "SELECT doc_id, text AS content FROM documents")
def s09(spark, sf):
    raw = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return decode_text(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw").select("doc_id", "content")


@query(
    "s10_read_any",
    union_sql([f"SELECT '{k}' AS source, s_suppkey, s_name, s_acctbal FROM supplier" for k in ("csv", "json", "parquet")]),
)
def s10(spark, sf):
    supplier = table(spark, sf, "supplier")
    base = scratch_path(spark, "supplier")
    supplier.write.option("header", True).csv(base + ".csv")
    supplier.write.json(base + ".json")
    supplier.write.parquet(base + ".parquet")
    out = None
    for kind in ("csv", "json", "parquet"):
        part = read_any(spark, f"{base}.{kind}").select(
            F.lit(kind).alias("source"), F.col("s_suppkey").cast("bigint"), "s_name", "s_acctbal"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("s11_preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def s11(spark, sf):
    return preview(table(spark, sf, "orders"), 5, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "s12_head_tail",
    """
    SELECT * FROM (SELECT o_orderkey, o_totalprice, 'head' AS side FROM orders ORDER BY o_orderkey LIMIT 3)
    UNION ALL
    SELECT * FROM (SELECT o_orderkey, o_totalprice, 'tail' AS side FROM orders ORDER BY o_orderkey DESC LIMIT 2)
    """,
)
def s12(spark, sf):
    return head_tail(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query(
    "s13_save_dataset",
    f"SELECT p_partkey, coalesce(p_type, 'Unknown') AS p_type, coalesce(p_brand, 'Unknown') AS p_brand, p_size FROM ({GAPPY_PART_SQL})",
)
def s13(spark, sf):
    path = scratch_path(spark, "saved")
    save_dataset(impute(gappy_part(spark, sf), ["p_type", "p_brand"], "unknown"), None, path)
    return load_dataset(spark, path)


_PART5 = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query(
    "s14_sample_values",
    union_sql(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY value) AS INT) AS rank
            FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM part)) WHERE rank <= 3"""
            for c in _PART5
        ]
    ),
)
def s14(spark, sf):
    return sample_values(table(spark, sf, "part"), max_cols=5)


@query(
    "s14_sample_values_all",
    union_sql(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY value) AS INT) AS rank
            FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM supplier)) WHERE rank <= 2"""
            for c in ("s_suppkey", "s_name", "s_nationkey", "address")
        ]
    ).replace("CAST(address AS VARCHAR)", "CAST(s_suppkey + 7 AS VARCHAR)"),
)
def s14_all(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name", "s_nationkey", "s_suppkey + 7 AS address")
    return sample_values(rows, 2)
