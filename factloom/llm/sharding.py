"""Sharding by jump consistent hashing, with DataFrame functions only.

The jump walk of Lamping and Veach (2014): a 64-bit linear congruential
sequence, seeded by the key, decides at which shard counts the key moves.  No
ring table is kept, and when one shard is appended a key either stays or moves
to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import fresh, materialize, small

#: Fixed value: the multiplier of the published generator, as two 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
WORD = 0xFFFFFFFF


def _low_product(a: Column, m: int) -> Column:
    """a * m modulo 2**32 for a below 2**32, in products that fit a signed 64-bit integer."""
    top = (F.shiftright(a, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(top, 16) + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(m)).bitwiseAND(F.lit(WORD))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a 64-bit integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(WORD)).alias("lo"), zero.alias("b"), zero.alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        # (hi, lo) * MULTIPLIER + 1, limb by limb: ANSI arithmetic doesn't wrap.
        p0 = s["lo"].bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW)
        p1 = F.shiftright(s["lo"], 16) * F.lit(LOW)
        low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
        hi = (carry + _low_product(s["hi"], LOW) + _low_product(s["lo"], HIGH)).bitwiseAND(F.lit(WORD))
        jump = F.floor((s["j"] + F.lit(1)) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")))
        moved = F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(WORD)).alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    # Each step raises j by one at least, so that `shards` steps always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["b"].cast("int"))


#: Rows of one bucket of a shard beyond which it is cut into parts.
HOT = 1 << 20


def integer_key(documents: DataFrame, key: str) -> Column:
    """The key as a 64-bit integer: integers as they are, anything else by its text's hash; null stays null."""
    kind = documents.schema[key].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def assign_shards(documents: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets: int = 1024, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more), ``size``, ``text_crc32`` and ``slot``.

    ``size``: UTF-8 bytes of the text plus 16; a null text has none, and a null
    checksum.  ``slot``: the row's place in its shard, from 0 without gaps, by
    (bucket of the key's md5, key, checksum).  Rows are numbered within a
    shard's bucket and shifted by the counts of the buckets before it, so a
    shard isn't sorted by one task; the table of counts has at most ``shards *
    buckets`` rows.  A bucket of more than ``hot`` rows, such as a key that
    holds a large share of them, is cut into parts by row: then the rows are
    written once, so that a row's number stays, and that bucket's rows are in
    no order.  Repeated rows each get a slot of their own; rows of one key
    always share a shard; keys other than integers count by their hash, a null
    key as 0.  An empty table gives an empty result.  Added columns replace
    columns of their name; all others stay.
    """
    added = ("shard", "grown_shard", "size", "text_crc32", "slot")
    bucket, part, row, number, base = fresh([*documents.columns, *added], "bucket", "part", "row", "number", "base")
    rest = [c for c in documents.columns if c.lower() not in added and (keep_text or c != text)]
    own = integer_key(documents, key)
    named = documents.select(
        *[F.col(f"`{c}`") for c in rest], (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16).cast("long")).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"), jump_hash(own, shards).alias("shard"), jump_hash(own, shards + 1).alias("grown_shard"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias(bucket),
    )
    # At most shards * buckets rows, whatever the input.
    counts = materialize(named.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(number)), "counts")
    if counts.where(F.col(number) > hot).take(1):
        named = materialize(named.withColumn(row, F.monotonically_increasing_id()), "rows")
        parts = F.ceil(F.col(number) / hot)
        named = named.join(F.broadcast(counts.where(F.col(number) > hot).select("shard", bucket, parts.alias(number))), ["shard", bucket], "left")
        named = named.withColumn(part, F.coalesce(F.pmod(F.xxhash64(row), F.col(number)), F.lit(0)).cast("int")).drop(number, row)
        counts = materialize(named.groupBy("shard", bucket, part).agg(F.count(F.lit(1)).alias(number)), "counts")
    else:
        named, counts = named.withColumn(part, F.lit(0)), counts.withColumn(part, F.lit(0))
    before = Window.partitionBy("shard").orderBy(bucket, part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, part, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("shard", bucket, part).orderBy(key, "text_crc32")
    placed = named.withColumn(row, F.row_number().over(within)).join(small(starts, shards * buckets), ["shard", bucket, part])
    slot = (F.col(base) + F.col(row) - 1).cast("long").alias("slot")
    return placed.select(*[F.col(f"`{c}`") for c in rest], "size", "text_crc32", "shard", "grown_shard", slot)
