"""Where a regular expression matches, in code points, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256
_BLOCK = 256


def blocks_of(text: str, wanted: Column) -> Column:
    """The text in blocks of equal length, from which stretch() cuts; none where it isn't wanted."""
    return F.when(wanted, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}+"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def stretch(blocks: str, start: Column, length: Column) -> Column:
    """Code points of the text from start on; it costs what the stretch is long, where a substring costs all before it."""
    first = F.floor(start / _BLOCK).cast("int")
    last = F.floor((start + length - 1) / _BLOCK).cast("int")
    return F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "").substr(start % _BLOCK + 1, length)


def around(blocks: str, start: Column, end: Column, near: int) -> tuple[Column, Column]:
    """Up to `near` code points before start, and as many from end on."""
    before = F.least(start, F.lit(near))
    return stretch(blocks, start - before, before), stretch(blocks, end, F.lit(near))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], gates: dict[str, Column]) -> DataFrame:
    """A column for each name in patterns: array<struct<start, end, value>> of the leftmost non-overlapping matches.

    gates: a cheap condition without which a text can't match. The columns come in steps, so that each is made once.
    """
    none = F.lit(None).cast("array<string>")
    for name, pattern in patterns.items():
        df = df.withColumn(f"{name}_m", F.when(gates[name], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for name, pattern in patterns.items():
        df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    # What is before each match: a piece and a match take turns. Sums of chunks come first, so that a text with many
    # matches doesn't cost their square. Every column that a lambda reads is read twice: else it would be moved into it.
    for name in patterns:
        both = F.zip_with(F.slice(f"{name}_p", F.lit(1), F.size(f"{name}_m")), f"{name}_m", lambda p, m: F.char_length(p) + F.char_length(m))
        df = df.withColumn(f"{name}_l", F.when(F.col(f"{name}_p").isNotNull(), both))
    for name in patterns:
        lengths = F.col(f"{name}_l")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: _total(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))))
        df = df.withColumn(f"{name}_c", F.when(lengths.isNotNull(), chunks))
    for name in patterns:
        chunks = F.col(f"{name}_c")
        df = df.withColumn(f"{name}_h", F.when(chunks.isNotNull(), F.transform(chunks, lambda _, c: _total(F.slice(chunks, F.lit(1), c)))))
    for name in patterns:
        lengths, heads = F.col(f"{name}_l"), F.col(f"{name}_h")
        chunk = lambda i: F.floor(i / _CHUNK).cast("int")
        df = df.withColumn(f"{name}_s", F.when(heads.isNotNull(), F.transform(lengths, lambda _, i: F.get(heads, chunk(i)) + _total(F.slice(lengths, chunk(i) * _CHUNK + 1, i % _CHUNK)))))
    for name in patterns:
        at = F.transform(f"{name}_m", lambda m, i: F.struct((F.get(f"{name}_s", i) + F.char_length(F.get(f"{name}_p", i))).alias("start"), m.alias("value")))
        found = F.transform(at, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end"), x["value"].alias("value")))
        empty = F.array().cast("array<struct<start:int, end:int, value:string>>")
        df = df.withColumn(name, F.when(F.col(f"{name}_s").isNotNull(), found).otherwise(empty))
    return df.drop(*(f"{n}_{x}" for n in patterns for x in "mplchs"))
