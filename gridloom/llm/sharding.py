"""Weighted rendezvous hashing of record keys over shards.

For each shard a key gets a hash u in (0, 1) and the score weight / -ln(u); the key
belongs to the shard with the highest score.  Shards get keys in proportion to
their weights.  A new shard only adds a score, so the keys that move are those it
wins; removing a shard moves its own keys only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, written

#: Hex digits of the hash that split a shard into ordered buckets for numbering.
BUCKET_DIGITS = 3
#: Hex digits of MD5 taken as a number: 52 bits, which a double holds exactly.
HASH_DIGITS = 13


def _score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, HASH_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 4 * HASH_DIGITS)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key; a shard of weight 0 gets none.

    `key` is a string; null is a key of its own.  Ties go to the lower number.
    """
    live = [(j, w) for j, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    key = F.coalesce(key, F.lit("null"))
    scores = [F.struct(_score(key, j, w).alias("score"), F.lit(-j).alias("shard")) for j, w in live]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], added_weight: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every record's shard, its slot there, and its shard if one more were added.

    Columns: doc_id, size (UTF-8 bytes of the text, null as none, and 1), text_crc32,
    law ("key": key and shard count decide), shard, slot (gapless from 0 in a shard),
    grown_shard.  Equal keys share a shard.  Slots follow hash buckets, then the key;
    equal rows get neighbouring slots.  Numbering is two-level: counts of (shard,
    bucket) give each bucket's first slot, so no task holds a whole shard.
    """
    rows = columns(docs, doc_id=id_column, text=text_column)
    key = F.col("doc_id").cast("string")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    bucket = F.substring(F.md5(F.concat(F.coalesce(key, F.lit("null")), F.lit("/"), crc.cast("string"))), 1, BUCKET_DIGITS)
    each = written(
        rows.select(
            "doc_id", size.alias("size"), crc.alias("text_crc32"), shard_of(key, weights).alias("shard"),
            bucket.alias("bucket"), shard_of(key, [*weights, added_weight]).alias("grown_shard"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = each.withColumn("inner", F.row_number().over(inside) - 1).join(firsts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inner")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, id_column: str = "doc_id") -> None:
    """Write the records themselves, a folder `shard=N` for each shard, with all their columns."""
    key, name = F.col(f"`{id_column}`").cast("string"), fresh(docs, "shard")
    docs.withColumn(name, shard_of(key, weights)).write.partitionBy(name).parquet(path)
