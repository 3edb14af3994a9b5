"""Sharding by jump consistent hashing, with DataFrame functions only.

The shard of a row depends on its key and the number of shards alone, without a ring table: the key
seeds a linear congruential generator, and each draw jumps to the next shard count at which the key
would move. One more shard therefore takes rows only into itself (law ``key``).

Slots number a shard's rows without one task ever holding a shard: rows fall into ``buckets`` per shard
by key and text, are ranked within their bucket, and the buckets' counts (at most shards x buckets rows,
whatever the input) give each bucket its first slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._common import table

SHARDS = 24
BUCKETS = 1024

#: Multiplier of the generator (fixed value of the method).
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK32, _MASK16 = 0xFFFFFFFF, 0xFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """High and low half of key * MULTIPLIER + 1 modulo 2**64; no product exceeds 63 bits."""
    mask16, mask32 = F.lit(_MASK16).cast("long"), F.lit(_MASK32)
    top = F.shiftright(lo, 16) * F.lit(_LOW)
    low = lo.bitwiseAND(mask16) * F.lit(_LOW) + F.shiftleft(top.bitwiseAND(mask16), 16) + F.lit(1).cast("long")
    cross = hi.bitwiseAND(mask16) * F.lit(_LOW) + F.shiftleft(
        (F.shiftright(hi, 16) * F.lit(_LOW)).bitwiseAND(mask16), 16
    )
    high = F.shiftright(low, 32) + F.shiftright(top, 16) + (lo * F.lit(_HIGH)).bitwiseAND(mask32) + cross
    return high.bitwiseAND(mask32), low.bitwiseAND(mask32)


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_MASK32))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of the key's ``shard`` among ``shards`` and ``grown`` among one more."""
    hi, lo = _halves(key)
    zero = F.lit(0).cast("long")
    start = F.struct(
        hi.alias("hi"), lo.alias("lo"), zero.alias("j"), zero.alias("shard"), zero.alias("grown")
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["hi"], s["lo"])
        draw = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        target = ((s["j"] + 1).cast("double") * draw).cast("long")
        moved = F.struct(
            high.alias("hi"),
            low.alias("lo"),
            target.alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
        )
        return F.when(s["j"] <= shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def assign_shards(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per document row ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A null text counts as empty, a null id as id 0 for the shard; rows with the same id share a shard;
    ties and repeated rows get slots of their own; other columns are ignored; an empty table gives no rows.
    The id must be an integer column.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    high, _ = _next(*_halves(key))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_shards(key, shards).alias("jump"),
        high.alias("mix"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("jump.shard").alias("shard"),
        F.col("jump.grown").alias("grown_shard"),
        F.pmod(F.col("mix").bitwiseXOR(F.col("text_crc32")), F.lit(buckets)).alias("bucket"),
    )
    counts = base.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    ranked = base.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    return ranked.join(first, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("rank")).alias("slot"),
        "grown_shard",
    )


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), base AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc
  FROM documents, tab
), jump AS (
  SELECT doc_id AS id, ((CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) + coalesce(doc_id, 0)) AS k,
    0::BIGINT AS j, 0::BIGINT AS shard, 0::BIGINT AS grown
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT id, nk, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST((nk // 8589934592) + 1 AS DOUBLE))) AS BIGINT),
    CASE WHEN j < 24 THEN j ELSE shard END, j
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM jump WHERE j <= 24)
), final AS (
  SELECT b.doc_id, b.size, b.crc, s.shard, s.grown,
    xor(CAST((((CASE WHEN b.doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) + coalesce(b.doc_id, 0)) * 2862933555777941757 + 1) % 18446744073709551616 // 4294967296 AS BIGINT), b.crc) % 1024 AS bucket
  FROM base b JOIN (SELECT id, max(shard) AS shard, max(grown) AS grown FROM jump GROUP BY id) s ON s.id IS NOT DISTINCT FROM b.doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM final
"""
