"""zstd as Arrow-batched functions; Spark has no such built-in. Apply them after the anti join that drops known chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compress(data: Column, level: int = 3) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        for s in batches:
            yield s.map(lambda x: None if x is None else c.compress(bytes(x)))

    return run(data)


def decompress(payload: Column) -> Column:
    """The raw bytes; null where the payload isn't a whole zstd frame."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        d = zstandard.ZstdDecompressor()

        def one(x: bytes | None) -> bytes | None:
            try:
                o = d.decompressobj()
                raw = o.decompress(bytes(x)) if x is not None else None
                return raw if x is not None and o.eof else None
            except zstandard.ZstdError:
                return None

        for s in batches:
            yield s.map(one)

    return run(payload)
