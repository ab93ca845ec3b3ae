"""Checks of stored chunks against their names, and of restored files against their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkIntegrityError
from ..functions.codec import decompress


def payload_status(payload: Column, data: Column, chunk_hash: Column) -> Column:
    return F.when(payload.isNull(), "missing").when(data.isNull() | (F.sha2(data, 256) != chunk_hash), "corrupt").otherwise("ok")


def measured(active: DataFrame, objects: DataFrame) -> DataFrame:
    """chunk_hash, status (ok, missing, corrupt) and raw_bytes of each hash in active, against the objects that should hold it."""
    found = active.select("chunk_hash").distinct().join(objects.select("chunk_hash", "payload"), "chunk_hash", "left").withColumn("data", decompress(F.col("payload")))
    return found.select("chunk_hash", payload_status(F.col("payload"), F.col("data"), F.col("chunk_hash")).alias("status"), F.octet_length("data").cast("bigint").alias("raw_bytes"))


def scan(active: DataFrame, objects: DataFrame) -> DataFrame:
    """chunk_hash and status of each hash in active."""
    return measured(active, objects).select("chunk_hash", "status")


def scan_raw(active: DataFrame, objects: DataFrame) -> DataFrame:
    """scan() of a store without compression (chunk_hash, data)."""
    found = active.select("chunk_hash").distinct().join(objects.select("chunk_hash", "data"), "chunk_hash", "left")
    return found.select("chunk_hash", payload_status(F.col("data"), F.col("data"), F.col("chunk_hash")).alias("status"))


def fsck(active: DataFrame, recorded: DataFrame, stored: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row of six counts: referenced, stored, missing, corrupt, orphans (recorded, unreferenced) and unrecorded."""
    sides = active.select("chunk_hash", F.lit(1).alias("a"), F.lit(0).alias("r"), F.lit(0).alias("s")).unionAll(recorded.select("chunk_hash", F.lit(0), F.lit(1), F.lit(0))).unionAll(stored.select("chunk_hash", F.lit(0), F.lit(0), F.lit(1)))
    each = sides.groupBy("chunk_hash").agg(F.max("a").alias("a"), F.max("r").alias("r"), F.max("s").alias("s"))
    bad = statuses.agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "corrupt").alias("corrupt"))
    sums = each.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("referenced"), F.coalesce(F.sum("s"), F.lit(0)).alias("stored"), F.count_if(F.expr("r = 1 and a = 0")).alias("orphans"), F.count_if(F.expr("r = 0 and (s = 1 or a = 1)")).alias("unrecorded"))
    return sums.crossJoin(bad).select("referenced", "stored", "missing", "corrupt", "orphans", "unrecorded")  # one row each


def require_ok(statuses: DataFrame) -> None:
    """ChunkIntegrityError naming a bad chunk, and how many there are, at a sink."""
    bad = statuses.where("status != 'ok'")
    first = bad.orderBy("chunk_hash").first()
    if first is not None:
        raise ChunkIntegrityError(f"{first.status} chunk {first.chunk_hash[:12]}, of {bad.count()} bad ones")


def _size_ok(raw: Column) -> Column:
    """Every chunk is there, has its recorded length (unless 0), and the lengths add up to the content."""
    right = raw.isNotNull() & ((F.col("chunk_length") == 0) | (raw == F.col("chunk_length")))
    total = F.sum("chunk_length")
    return F.bool_and(right) & ((total == 0) | (F.coalesce(F.sum(raw), F.lit(0)) == total))


def restore(refs: DataFrame, data: DataFrame) -> DataFrame:
    """path, content, size_ok: files put together from chunk_refs rows and (chunk_hash, data), in their order.

    A row holds a whole file, so this is for files below 2 GB; checkout writes larger ones chunk by chunk.
    """
    each = refs.join(data.select("chunk_hash", "data"), "chunk_hash", "left").withColumn("raw", F.octet_length("data").cast("bigint"))
    content = F.coalesce(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY chunk_order)"), F.lit(b""))
    return each.groupBy(F.col("file_path").alias("path")).agg(content.alias("content"), _size_ok(F.col("raw")).alias("size_ok"))


def restorable(refs: DataFrame, known: DataFrame) -> DataFrame:
    """path, size, size_ok of the files of chunk_refs rows, from measured() chunks: no content is held."""
    each = refs.join(known.where("status = 'ok'").select("chunk_hash", "raw_bytes"), "chunk_hash", "left")
    return each.groupBy(F.col("file_path").alias("path")).agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("size"), _size_ok(F.col("raw_bytes")).alias("size_ok"))
