"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg), in DataFrame operations only.

A text's UTF-8 is cut into blocks of a fixed size. The distinct blocks are sorted and numbered: a block's integer name.
Adjacent names are paired, the distinct pairs are sorted and numbered the same way, level by level, until one name is
left; with the length it is the text's identity. Texts of one length have the same levels, so two of them get one
identity exactly when they are equal.

Blocks are dealt out by their bytes and sorted within each part; a name holds the part's number and the place in it.
The bytes are shuffled once, after equal ones were combined where they are read, so a block that a third of all rows
share costs a row a task. Names find their blocks by a 64-bit hash: hashes that several blocks share are looked for,
and those blocks are joined by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from .common import ascii_lower, drop, free, mark, materialise, release, small

#: Bytes in a block.
BLOCK = 1024
IDENTITY = ["n_bytes", "name"]
_NUMBER = F.monotonically_increasing_id


def _blocks(data: Column, block: int) -> Column:
    last = F.floor(F.greatest(F.length(data) - 1, F.lit(0)) / block).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: data.substr(i * block + 1, F.lit(block)))


def _hash(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _pairs(names: Column) -> Column:
    """Adjacent names as structs a, b; an odd one at the end has no b."""
    half = F.floor((F.size(names) + 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get(names, 2 * i).alias("a"), F.get(names, 2 * i + 1).alias("b")))


def _normal(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")


def _collected(rows: DataFrame) -> DataFrame:
    """row and its names in order, of (row, pos, name): a row's own blocks."""
    lists = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return lists.select("row", F.transform("l", lambda x: x["name"]).alias("names"))


def name_documents(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the identity (n_bytes, name) of every row's ASCII-lower-cased text.

    A null text counts as empty; an empty text is one empty block. Null doc_ids and repeated rows stay rows of
    their own. Other columns are ignored. bits: of a block's hash; fewer than 64 only to try out shared ones.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal("text").alias("data")).withColumn("row", _NUMBER())
    every = src.select(F.explode(_blocks(F.col("data"), block)).alias("v"))
    names = materialise(every.distinct().sortWithinPartitions("v").select(_hash(F.col("v"), bits).alias("h"), _NUMBER().alias("name")), "names")
    shared = materialise(names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    mixed = not shared.isEmpty()
    if mixed:
        src = materialise(src, "rows")  # row numbers that hold for several scans
    hashes = F.transform(_blocks(F.col("data"), block), lambda b: _hash(b, bits))
    named = materialise(src.select("row", "doc_id", F.sha2("data", 256).alias("text_sha256"), F.length("data").cast("long").alias("n_bytes"), hashes.alias("h")), "named")
    places = named.select("row", F.posexplode("h").alias("pos", "h"))
    found = places.join(names, "h").select("row", "pos", "name")
    if mixed:
        found = places.join(names.join(shared, "h", "left_anti"), "h").select("row", "pos", "name")
        held = src.select("row", F.posexplode(_blocks(F.col("data"), block)).alias("pos", "v")).withColumn("h", _hash(F.col("v"), bits)).join(shared, "h", "left_semi")
        own = materialise(held.select("v").distinct().sortWithinPartitions("v").select("v", (-1 - _NUMBER()).alias("name")), "own")
        found = found.unionAll(held.join(own, "v").select("row", "pos", "name"))
    now, done = materialise(_collected(found), "level-0"), []
    most = named.agg(F.max("n_bytes")).first()[0] or 0
    levels = max(0, (max(1, -(-most // block)) - 1).bit_length())
    for level in range(levels):
        done.append(now.where("size(names) = 1").select("row", F.col("names")[0].alias("name")))
        pairs = now.where("size(names) > 1").select("row", F.posexplode(_pairs(F.col("names"))).alias("pos", "p")).select("row", "pos", "p.a", "p.b")
        names = materialise(pairs.where("b is not null").select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", _NUMBER().alias("name")), "names")
        both = pairs.where("b is not null").join(names, ["a", "b"]).select("row", "pos", "name")
        now = materialise(_collected(both.unionAll(pairs.where("b is null").select("row", "pos", "a"))), f"level-{level + 1}")
        drop(names)
    done.append(now.select("row", F.col("names")[0].alias("name")))
    last = done[0]
    for d in done[1:]:
        last = last.unionAll(d)
    return named.drop("h").join(last, "row").select("doc_id", "text_sha256", "n_bytes", "name")


def _identified(docs: DataFrame, block: int, bits: int = 64) -> DataFrame:
    """name_documents() as a table; what it was made of is removed."""
    since = mark(docs.sparkSession)
    out = materialise(name_documents(docs, block, bits), "identities")
    release(docs.sparkSession, since, [out])
    return out


def duplicates(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with the
    largest doc_id stays; null doc_ids stay only in groups without others. Rows that repeat doc_id and text are
    all reported alike. An empty table gives no rows.
    """
    named = _identified(docs, block, bits)
    groups = materialise(named.groupBy(*IDENTITY).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    both = named.join(groups, IDENTITY, "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return both.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of documents that stay, with all their columns: one per text, also where doc_ids or rows repeat.

    As in duplicates(); of rows that share the largest doc_id and the text the one whose columns are greatest stays,
    compared from left to right (any one, if a column is a map). Only groups of several rows are joined, a row for
    each; texts are shuffled only where there are too many groups to be broadcast.
    """
    named = _identified(docs, block)
    each = named.groupBy(*IDENTITY, "doc_id").agg(F.count("*").alias("n"), F.min("text_sha256").alias("sha"))
    groups = each.groupBy(*IDENTITY).agg(F.max(F.struct("doc_id", "n")).alias("k"), F.sum("n").alias("size"), F.min("sha").alias("sha")).where("size > 1")
    sha, keep = free(docs, "text_sha"), free(docs, "keep")
    groups = materialise(groups.select(F.col("sha").alias(sha), F.struct("k.doc_id", "k.n").alias(keep)), "groups")
    n, repeats = groups.count(), groups.where(f"{keep}.n > 1").select(sha)
    marked = docs.withColumn(sha, F.sha2(_normal("text"), 256)).join(small(groups, n), sha, "left")
    kept = marked.where(F.col(keep).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(f"{keep}.doc_id")))
    if repeats.isEmpty():
        return kept.select(docs.columns)
    several = kept.where(F.col(f"{keep}.n") > 1)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = several.groupBy(sha).agg((F.max(whole) if _ordered(docs.schema) else F.first(whole)).alias(keep)).select(f"{keep}.*")
    return kept.where(F.col(keep).isNull() | (F.col(f"{keep}.n") == 1)).select(docs.columns).unionAll(one)


def _ordered(schema: StructType) -> bool:
    """Whether rows can be compared: no column is or holds a map or a variant."""
    return not any(isinstance(f.dataType, MapType) or "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in schema.fields)
