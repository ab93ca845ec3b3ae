"""The object store as a table: chunk_hash -> compressed payload, partitioned by the hash's first two digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import compress, decompress
from ..functions.scalars import object_path


def as_objects(chunks: DataFrame) -> DataFrame:
    """prefix, chunk_hash, payload of processed chunks that have a payload, each hash once."""
    return chunks.where("payload is not null").select(F.substring("chunk_hash", 1, 2).alias("prefix"), "chunk_hash", "payload").dropDuplicates(["chunk_hash"])


def missing_from(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """chunk_hash of each chunk that the store lacks; the bytes aren't moved."""
    return chunks.select("chunk_hash").distinct().join(objects.select("chunk_hash"), "chunk_hash", "left_anti")


def new_objects(data: DataFrame, level: int = 3) -> DataFrame:
    """Rows of the object table for chunks (chunk_hash, data) that are what their name says; others are left out."""
    sure = data.where(F.sha2("data", 256) == F.col("chunk_hash")).withColumn("payload", compress(F.col("data"), level))
    return sure.select(F.substring("chunk_hash", 1, 2).alias("prefix"), "chunk_hash", F.octet_length("data").cast("bigint").alias("raw_bytes"), F.octet_length("payload").cast("bigint").alias("stored_bytes"), "payload")


def present_in(hashes: DataFrame, objects: DataFrame) -> DataFrame:
    return hashes.join(objects.select("chunk_hash"), "chunk_hash", "left_semi")


def list_objects(objects: DataFrame) -> DataFrame:
    """chunk_hash and path of every object; payloads aren't read."""
    return objects.select("chunk_hash", object_path(F.col("chunk_hash")).alias("path"))


def object_sizes(objects: DataFrame) -> DataFrame:
    """chunk_hash and stored_bytes; payloads are read only where the table doesn't have their size."""
    if "stored_bytes" in objects.columns:
        return objects.select("chunk_hash", "stored_bytes")
    return objects.select("chunk_hash", F.octet_length("payload").cast("bigint").alias("stored_bytes"))


def retrieve(hashes: DataFrame, objects: DataFrame, verify: bool = False) -> DataFrame:
    """hashes with data, null where the object is missing or, with verify, isn't what its name says."""
    found = hashes.join(objects.select("chunk_hash", "payload"), "chunk_hash", "left").withColumn("data", decompress(F.col("payload"))).drop("payload")
    return found.withColumn("data", F.when(F.sha2("data", 256) == F.col("chunk_hash"), F.col("data"))) if verify else found


def resolve(hashes: DataFrame, canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """hashes with layout (canonical, legacy or null) and payload: the canonical layout comes first."""
    c = canonical.select("chunk_hash", F.col("payload").alias("c"))
    old = legacy.select("chunk_hash", F.col("payload").alias("l"))
    both = hashes.join(c, "chunk_hash", "left").join(old, "chunk_hash", "left")
    return both.withColumn("layout", F.when(F.col("c").isNotNull(), "canonical").when(F.col("l").isNotNull(), "legacy")).withColumn("payload", F.coalesce("c", "l")).drop("c", "l")


def fanout(objects: DataFrame) -> DataFrame:
    return objects.groupBy(F.substring("chunk_hash", 1, 2).alias("prefix")).agg(F.count("*").alias("objects"))


def migrated(canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """The flat layout's objects that the canonical table lacks, as its rows."""
    new = legacy.join(canonical.select("chunk_hash"), "chunk_hash", "left_anti").dropDuplicates(["chunk_hash"])
    return new.select(F.substring("chunk_hash", 1, 2).alias("prefix"), "chunk_hash", F.lit(None).cast("bigint").alias("raw_bytes"), F.octet_length("payload").cast("bigint").alias("stored_bytes"), "payload")


def migrate(canonical: DataFrame, legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The canonical table with the flat layout's objects, and a row (migrated, bytes) that also counts redundant flat copies."""
    columns = ["prefix", "chunk_hash", "payload"]
    after = canonical.select(*columns).unionByName(migrated(canonical, legacy).select(*columns))
    return after, legacy.agg(F.count("*").alias("migrated"), F.coalesce(F.sum(F.octet_length("payload").cast("bigint")), F.lit(0)).alias("bytes"))


def garbage(objects: DataFrame, active: DataFrame) -> DataFrame:
    """Objects that no commit references."""
    return objects.join(active.select("chunk_hash"), "chunk_hash", "left_anti")


def freed(gone: DataFrame) -> DataFrame:
    """A row (deleted, freed_bytes) of the objects in gone."""
    return object_sizes(gone).agg(F.count("*").alias("deleted"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("freed_bytes"))


def collect_garbage(objects: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects that stay, and a row (deleted, freed_bytes)."""
    return objects.join(active.select("chunk_hash"), "chunk_hash", "left_semi"), freed(garbage(objects, active))
