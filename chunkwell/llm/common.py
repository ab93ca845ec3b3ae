"""Shared pieces of the corpus operators: scratch tables, ASCII lower-casing, batching of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import session
from ..sources.session import mark, release, scratch_path, ship  # noqa: F401  scratch tables and their removal, for the operators

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text handled at a time in Python: bounds a worker's memory whatever the length of Spark's batches.
SLICE_CHARS = 1_000_000
#: Files of a scratch table whose rows are known, at least, and rows in one.
FILES, ROWS_A_FILE = 24, 20_000
#: Rows of a small table that is broadcast, at most, where they are known: of a few words each, some 100 MB.
FEW = 1_000_000
#: Row numbers, of 8 bytes each, that are broadcast at most.
IDS = 4_000_000


def materialise(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    rows: about how many there may be at most, where that is known; a small table then gets few files, not one for
    each shuffle partition. It only ever lowers their number.
    """
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(FILES, rows // ROWS_A_FILE))).write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that materialise() made and that nothing will read again."""
    session.remove(df.sparkSession, df.__dict__["_scratch"])


def small(df: DataFrame, rows: int, few: int = FEW) -> DataFrame:
    """df, to be broadcast in a join if it has few rows; beyond that Spark chooses by its size."""
    return F.broadcast(df) if rows <= few else df


def free(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with a number for each row, and whether it is the doc_id: so if none is null or repeated. Else the rows are
    written with numbers of their own, which hold for several scans."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    once = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()
    if once:
        return docs.withColumn(name, F.col("doc_id").cast("long")), True
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), False


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that on ASCII text, and much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def prepare(spark: SparkSession) -> None:
    """The package on the executors."""
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, whose session gets small Arrow batches: rows are whole texts. Operators set nothing."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, text_at: int) -> Iterator:
    """Cut Arrow batches into slices of about SLICE_CHARS bytes of the text column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_CHARS, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Bytes -> lower-case ASCII letters, digits and bytes from 0x80 as they are; everything else a space.
WORD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes -> lower-case ASCII letters; all others as they are.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the ASCII-lower-cased text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []
