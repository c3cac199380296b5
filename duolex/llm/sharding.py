"""Contiguous shards of about equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolex.llm.common import before_part, documents, query, ranged
from duolex.session import materialize


def byte_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row in one of `shards` runs of the order of `key`.

    A row's size is its text's UTF-8 bytes plus one, so a null or empty text still takes room.
    Ranges of the order are summed, the sums of earlier ranges give each range its start, and a
    window inside each range does the rest; a row goes to the shard its middle byte falls into.
    Null keys come first; rows of equal key are ordered by checksum and size, and rows equal in
    all three may swap slots. An empty table gives no rows; other columns are not read.
    """
    sized = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    order = ["_key", "text_crc32", "size"]
    stored = ranged(sized, *order, name="shard-sizes")
    bases = before_part(stored, _bytes=F.sum("size"), _rows=F.count(F.lit(1)))
    total = stored.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    inside = Window.partitionBy("part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        stored.join(F.broadcast(bases), "part")
        .withColumn("_start", F.col("_bytes") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("_index", F.col("_rows") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"int((2 * _start + size) * {shards} div (2 * {total}L))"))
        .select(*order, "shard", "_index")
    )
    placed = materialize(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )


SHARD_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
      lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
      lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS text_crc32
  FROM bytes, crc_table),
placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER () AS total FROM summed),
cut AS (SELECT *, ((2 * start + size) * 16 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""


@query("op6_sharding", SHARD_SQL)
def op6_sharding(spark, sf_dir):
    return byte_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
