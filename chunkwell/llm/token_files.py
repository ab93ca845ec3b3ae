"""Token ids as files: segments of rANS blocks in ascending doc_id order.

The container is Parquet, one row per segment, so Spark's commit protocol and any Hadoop store work. A segment has
its frequency table, shared by its independent blocks, and the ids and lengths of its documents. Blocks have lane
checkpoints and checksums; segments, blocks and the stretches between checkpoints decode in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices
from .packing import widen
from .tokens import Encoder, default_tokenizer

#: Ids in a segment: bounds what a task holds.
SEGMENT = 1 << 20
#: Ranges of doc_id at most: bounds what the quantile sketch brings to the driver, some 100 MB. 100 TB in splits of
#: 128 MB make four splits a range; a range is sorted on disk, so it may be larger than memory.
MAX_SHARDS = 200_000
_ROWS = "bucket int, doc_id long, n long, ids binary, width int"
_BLOCK = "struct<n:long, lanes:int, words:binary, marks:array<struct<step:long, word:long, state:binary>>, crc:long>"
FORMAT = f"shard int, segment int, shard_start long, n_tokens long, freq binary, docs binary, blocks array<{_BLOCK}>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None) -> None:
    """Tokenise documents (doc_id, text) and write them to path in ascending doc_id order.

    A null text is empty: the end id alone. Null doc_ids come first. Rows with one doc_id are ordered by their
    number of ids, then by the bytes of the ids. An empty table writes no segments. Other columns are ignored. A document longer
    than a segment is split over blocks of its own segment.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    shards = min(shards or max(1, docs.rdd.getNumPartitions()), MAX_SHARDS)
    cuts = docs.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    bounds = sorted({int(c) for c in cuts})

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = Encoder.of(tokenizer)
        width, end = encoder.width, end_id.to_bytes(encoder.width, "little")
        for b in slices(batches, 1):
            ids = [x + end for x in encoder.ids(b.column(1).to_pylist())]
            where = np.searchsorted(bounds, pc.fill_null(b.column(0), -(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), b.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], ["bucket", "doc_id", "n", "ids", "width"])

    rows = docs.mapInArrow(encode, _ROWS).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "ids")
    rows.mapInArrow(_segments, FORMAT).write.option("compression", "none").parquet(path)


def _segments(batches: Iterator) -> Iterator:
    import zlib

    import numpy as np
    import pyarrow as pa

    from . import rans

    marks = pa.list_(pa.struct([("step", pa.int64()), ("word", pa.int64()), ("state", pa.binary())]))
    block = pa.struct([("n", pa.int64()), ("lanes", pa.int32()), ("words", pa.binary()), ("marks", marks), ("crc", pa.int64())])
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("freq", pa.binary()), ("docs", pa.binary()), ("blocks", pa.list_(block))])
    docs: list[tuple] = []
    state = {"shard": None, "segment": 0, "start": 0, "held": 0}

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(d[2] for d in docs), "<u4")
        table = rans.Table.of(ids)
        blocks = []
        for i in range(0, len(ids), rans.BLOCK):
            b = rans.encode(ids[i : i + rans.BLOCK], table)
            blocks.append(b | {"marks": [dict(zip(("step", "word", "state"), m)) for m in b["marks"]]})
        index = np.array([(d[0] is None, d[0] or 0, d[1]) for d in docs], "<i8")
        row = {"shard": state["shard"], "segment": state["segment"], "shard_start": state["start"], "n_tokens": len(ids), "freq": table.dump(), "docs": zlib.compress(index.T.tobytes()), "blocks": blocks}
        state["segment"] += 1
        state["start"] += len(ids)
        state["held"] = 0
        docs.clear()
        return pa.RecordBatch.from_pylist([row], schema)

    for b in slices(batches, 3):
        for bucket, doc, n, ids, width in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != state["shard"]:
                if docs:
                    yield flush()
                state.update(shard=bucket, segment=0, start=0)
            docs.append((doc, n, widen(ids, width)))
            state["held"] += n
            if state["held"] >= SEGMENT:
                yield flush()
    if docs:
        yield flush()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    import numpy as np

    prepare(spark)
    files = spark.read.schema(FORMAT).parquet(path)
    totals = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each shard
    shards, sums = np.array([s for s, _ in totals]), np.cumsum([0] + [n for _, n in totals])

    def decode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from . import rans

        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                table = rans.Table.load(r["freq"])
                ids = np.concatenate([rans.decode(b | {"marks": [(m["step"], m["word"], m["state"]) for m in b["marks"]]}, table) for b in r["blocks"]])
                null, doc, n = np.frombuffer(zlib.decompress(r["docs"]), "<i8").reshape(3, -1)
                start = int(sums[np.searchsorted(shards, r["shard"])]) + r["shard_start"] + np.cumsum(n) - n
                ends = np.concatenate([[0], np.cumsum(n)]) * 4
                for a in range(0, len(n), 256):
                    z = min(len(n), a + 256)
                    whole = memoryview(ids.tobytes())[ends[a] : ends[z]] if a == 0 and z == len(n) else ids[ends[a] // 4 : ends[z] // 4].tobytes()
                    data = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((ends[a : z + 1] - ends[a]).astype("<i4").tobytes()), pa.py_buffer(whole)])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a:z], mask=null[a:z] != 0), pa.array(start[a:z]), pa.array(n[a:z]), data], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
