"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts the HASHES filter positions of all text hashes and keeps those that were hit twice or more as bitmaps. Pass two tests every row
against these bitmaps by broadcast joins: a row with a position that was hit once has no copy and passes straight through; only the rest
is shuffled by its hash and grouped. A false positive costs a row of shuffle and never changes the result.

The broadcast has a fixed bound: at most MAX_BITS / 8 bytes of bitmaps (32 MiB), whatever the corpus. Beyond MAX_BITS / BITS_PER_ROW rows (8 million) the
filter grows fuller and lets more rows through to the shuffle; beyond some 10^8 rows it holds back few. Results stay exact; `duplicate_groups` then shuffles
fingerprints of 40 bytes a row, `drop_duplicates_exact` the rows themselves.

Defined cases: a null text counts as empty; empty texts are equal to each other. Rows that repeat a doc_id with the same text share one decision.
A null doc_id never wins over another one. An empty table gives no rows. Other columns are ignored by `duplicate_groups` and
kept as they are by `drop_duplicates_exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import SPACE_CLASS, text_of, written, written_whole

BITS_PER_ROW = 32
#: Positions of a key in the filter.
HASHES = 2
MAX_BITS = 1 << 28
#: Bits in one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32768


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), f"{SPACE_CLASS}+", " ")


def text_key(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))


def filter_bits(rows: int) -> int:
    """A power of two of at least BITS_PER_ROW bits a row, between one bitmap and MAX_BITS."""
    bits = BITMAP_BITS
    while bits < min(MAX_BITS, rows * BITS_PER_ROW):
        bits *= 2
    return bits


def _positions(bits: int, key: str = "key") -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def filter_of(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """(bucket, bitmap) of the filter positions that `least` or more rows hit: at most bits / BITMAP_BITS rows of 4 KiB."""
    hit = keys.select(F.explode(F.array(*_positions(bits))).alias("position")).groupBy("position").count().filter(F.col("count") >= least)
    return hit.groupBy(F.expr(f"position div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("position") % BITMAP_BITS).alias("bitmap"))


def with_suspicion(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Adds `suspect`: all filter positions of the row's key are set. No shuffle: the bitmaps have a fixed bound and are broadcast."""
    columns = rows.columns
    bit = F.expr(f"shiftright(cast(conv(hex(substring(bitmap, cast(position % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int), cast(position % 8 as int)) & 1")
    rows = rows.withColumn("suspect", F.lit(True))
    for position in _positions(bits):
        at = rows.withColumn("position", position).withColumn("bucket", F.expr(f"position div {BITMAP_BITS}"))
        rows = at.join(F.broadcast(bitmaps), "bucket", "left").withColumn("suspect", F.col("suspect") & F.coalesce(bit == 1, F.lit(False))).select(*columns, "suspect")
    return rows


def _groups(keys: DataFrame, bitmaps: DataFrame, bits: int, rows: int) -> DataFrame:
    """(key, keep_id, group_size) of every key that two or more of the rows have; written, so that the join below can split a hot key."""
    suspects = with_suspicion(keys, bitmaps, bits).filter("suspect")
    return written(
        suspects.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "exact-groups", rows // 2
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = written(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key")), "exact-keys")
    rows = keys.count()
    bits = filter_bits(rows)
    bitmaps = written_whole(filter_of(keys, bits, 2), "exact-bitmaps", bits // BITMAP_BITS)
    groups = _groups(keys, bitmaps, bits, rows)
    tested = with_suspicion(keys, bitmaps, bits)
    alone = tested.filter("not suspect").select("id", "key", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = tested.filter("suspect").drop("suspect").join(groups, "key", "left").select(
        "id", "key", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )
    return alone.unionByName(suspects).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256")
    )


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows without a copy are not shuffled."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[id_col].alias("id"), text_key(text_col).alias("key"))
    keys = written(keyed.select("id", "key"), "exact-keys")
    rows = keys.count()
    bits = filter_bits(rows)
    bitmaps = written_whole(filter_of(keys, bits, 2), "exact-bitmaps", bits // BITMAP_BITS)
    groups = _groups(keys, bitmaps, bits, rows)
    tested = with_suspicion(keyed, bitmaps, bits)
    suspects = tested.filter("suspect").join(groups, "key", "left").filter(F.col("keep_id").isNull() & F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    return tested.filter("not suspect").select("row.*").unionByName(suspects.select("row.*"))


def op8(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
