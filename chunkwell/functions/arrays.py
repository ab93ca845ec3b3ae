"""Sums over arrays, and places of rows in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import written

_CHUNK = 256


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def with_prefix_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """A column out with, for each place of the array column lengths, the sum of what is before it; null stays null.

    Sums of chunks come first, so a long array doesn't cost its square. Each step is a projection of its own, and
    what a lambda reads is read twice: else the optimizer would move it into the lambda.
    """
    n, chunks, heads = F.col(lengths), F.col("_chunks"), F.col("_heads")
    part = lambda i: F.floor(i / _CHUNK).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(n), F.lit(1)) - 1) / _CHUNK).cast("int")), lambda c: total(F.slice(n, c * _CHUNK + 1, F.lit(_CHUNK))))
    df = df.withColumn("_chunks", F.when(n.isNotNull(), each))
    df = df.withColumn("_heads", F.when(chunks.isNotNull(), F.transform(chunks, lambda _, c: total(F.slice(chunks, F.lit(1), c)))))
    sums = F.transform(n, lambda _, i: F.get(heads, part(i)) + total(F.slice(n, part(i) * _CHUNK + 1, i % _CHUNK)))
    return df.withColumn(out, F.when(heads.isNotNull(), sums)).drop("_chunks", "_heads")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None) -> DataFrame:
    """df with out, each row's place from 0 among the rows of its keys in order, and total, how many these are.

    Rows are dealt out by ranges and counted inside a range; only the ranges' counts, a row for each range and key,
    are summed up, so no task holds all rows of a key. order must tell the rows of a key apart for a stable result.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_part", F.shiftright("_id", 33)), "numbered")  # an id's upper bits are its partition
    parts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    rest = Window.partitionBy(*keys)
    base = parts.select(F.col("_part").alias("_at"), *(F.col(k).alias(f"_key_{k}") for k in keys), (F.sum("_n").over(rest.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_base"), *([F.sum("_n").over(rest).alias(total)] if total else []))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return dealt.join(base, same).select(*df.columns, (F.col("_id") + F.col("_base")).alias(out), *([total] if total else []))
