"""Packing: concatenate all documents' token ids and cut the stream into fixed windows.

Pass 1 tokenises each input partition once and writes its ids with offsets inside the partition. The token totals
of the partitions, one number each, are summed up on the driver; pass 2 turns them into global offsets and cuts
every document at the window boundaries. Nothing is sorted or shuffled, and only the stream's last window is short.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import materialise, prepare, slices
from .tokens import Encoder, default_tokenizer

_IDS = "part long, part_start long, doc_id long, n long, ids binary, width long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document: ids (little-endian of `width` bytes, end id included) and where it starts in its input partition."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, at = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        width, end = encoder.width, end_id.to_bytes(encoder.width, "little")
        for b in slices(batches, 1):
            ids = [x + end for x in encoder.ids(b.column(1).to_pylist())]
            n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(starts), b.column(0), pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(len(n), width, np.int64))], ["part", "part_start", "doc_id", "n", "ids", "width"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(encode, _IDS)


def widen(ids: bytes, width: int) -> bytes:
    """Ids of `width` bytes as little-endian unsigned 32-bit ones."""
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def padded_length(length: int, window: int) -> int:
    """A sequence is padded to the window unless its length is a power of two."""
    return length if length & (length - 1) == 0 else window


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most `window` tokens; see PIECES.

    A null text counts as empty (its end id alone is packed); a null doc_id is kept as null; repeated rows are
    packed each on its own; other columns are ignored; an empty table gives no pieces. A document of any length
    is cut wherever windows end.
    """
    import numpy as np

    spark = docs.sparkSession
    prepare(spark)
    ids = materialise(token_table(docs, tokenizer or default_tokenizer(), end_id), "pack-ids")
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect())  # a row for each partition
    parts = np.array([p for p, _ in totals], np.int64)
    sums = np.cumsum([0] + [n for _, n in totals])
    shared = spark.sparkContext.broadcast((parts, sums))

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        parts, sums = shared.value
        total = int(sums[-1])
        for b in slices(batches, 4):
            rows: list[tuple] = []
            for part, at, doc, n, raw, width in zip(*(c.to_pylist() for c in b.columns)):
                g, data, start = int(sums[np.searchsorted(parts, part)]) + at, memoryview(widen(raw, width)), 0
                while start < n:
                    seq, off = divmod(g + start, window)
                    length = min(window - off, n - start)
                    rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, seq, off, padded_length(min(window, total - seq * window), window)))
                    start += length
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)], names)

    return ids.mapInArrow(cut, PIECES)
