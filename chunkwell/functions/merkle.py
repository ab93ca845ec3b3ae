"""Merkle trees over ordered leaf hashes: adjacent hashes are paired bottom-up and an odd one is promoted.

A tree is folded 256 leaves at a time: a block gives its root, and the blocks' roots are the next round's leaves. So a
group may have any number of leaves, a row holds 256 of them at most, and n leaves take log256(n) shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship, written
from .arrays import numbered

#: Levels that a round folds; a block has 2**FOLD leaves.
FOLD = 8
NODE = "node_path string, level int, hash string, is_leaf boolean, leaf_pos bigint"


def combine(left: Column, right: Column) -> Column:
    """SHA-256 of the two hex texts, one after the other."""
    return F.sha2(F.concat(left, right), 256)


def _paired(a: Column, both: Callable[[Column, Column], Column] = combine) -> Column:
    """The level above a: adjacent elements combined, an odd last one as it is."""
    last = F.floor((F.size(a) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(F.get(a, 2 * i + 1).isNull(), F.get(a, 2 * i)).otherwise(both(F.get(a, 2 * i), F.get(a, 2 * i + 1))))


def _folded(a: Column, both: Callable[[Column, Column], Column] = combine) -> Column:
    """What is left of up to 2**FOLD elements."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), a, lambda x, _: _paired(x, both)), F.lit(0))


def root_of(leaves: Column) -> Column:
    """The root of an array of leaf hashes; null for none. For small arrays: larger trees are roots()."""
    levels = F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int")
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), leaves, lambda a, _: _paired(a))
    return F.when(F.size(leaves) > 0, F.get(folded, F.lit(0)))


def _rounds(most: int) -> int:
    return max(1, -(-max(0, most - 1).bit_length() // FOLD))


def _blocks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, up and l: the values of each block of 2**FOLD places in their order."""
    block = rows.groupBy(*keys, "n", F.shiftright("pos", FOLD).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("l"))
    return block.withColumn("l", F.transform("l", lambda x: x[value]))


def _placed(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> tuple[DataFrame, int]:
    """keys, pos, n, hash, and the most leaves that a group has."""
    rows = numbered(leaves.select(*keys, F.col(order).alias("_order"), F.col(leaf).alias("hash")), keys, ["_order"], "pos", "n")
    return rows.select(*keys, "pos", "n", "hash"), rows.agg(F.max("n")).first()[0] or 0


def _up(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    for _ in range(_rounds(most)):
        rows = _blocks(rows, keys, "hash").select(*keys, "n", F.col("up").alias("pos"), _folded(F.col("l")).alias("hash"))
    return rows


def roots(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    """keys, n_leaves and merkle_root of each group's leaves in their order."""
    rows, most = _placed(leaves, keys, order, leaf)
    return _up(rows, keys, most).select(*keys, F.col("n").alias("n_leaves"), F.col("hash").alias("merkle_root"))


def root(leaves: DataFrame, pos: str, leaf: str) -> str | None:
    """The root of any number of leaves at consecutive places from 0."""
    rows = leaves.select(F.col(pos).cast("bigint").alias("pos"), F.col(leaf).alias("hash"), F.lit(0).alias("n"))
    last = rows.agg(F.max("pos")).first()[0]
    return None if last is None else _up(rows, [], last + 1).first().hash


def tree(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    """keys, n, top, level, pos, hash, real: every level's hashes, leaves (level 0) to root (level top).

    real: whether the node was made at this level, and not promoted from below. Each round's levels are written.
    """
    now, most = _placed(leaves, keys, order, leaf)
    top = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    out = None
    for k in range(_rounds(most)):
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), F.array("l"), lambda acc, _: F.concat(acc, F.array(_paired(F.element_at(acc, -1)))))
        folded = _blocks(now, keys, "hash").withColumn("t", levels)
        each = folded.select(*keys, "n", "up", F.posexplode(F.transform("t", lambda a, j: F.struct(a.alias("a"), F.when(j > 0, F.size(F.get("t", j - 1))).otherwise(0).alias("below")))).alias("j", "x"))
        each = each.where("j > 0" if k else "true").select(*keys, "n", top.alias("top"), (F.col("j") + FOLD * k).alias("level"), "up", "j", F.col("x.below").alias("below"), F.posexplode("x.a").alias("i", "hash")).where("level <= top")
        pos, real = F.expr(f"shiftleft(up, {FOLD} - j) + i"), (F.col("level") == 0) | (F.col("below") > 2 * F.col("i") + 1)
        rows = written(each.select(*keys, "n", "top", "level", pos.alias("pos"), "hash", real.alias("real"), F.col("j")), "tree")
        now = rows.where(f"j = {FOLD}").select(*keys, "n", "pos", "hash")
        out = rows.drop("j") if out is None else out.unionAll(rows.drop("j"))
    return out


def nodes(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    """The whole tree as rows: keys, node_path ('' for the root, then L and R), level, hash, is_leaf, leaf_pos.

    A promoted node takes the place of the parent that it doesn't have, as the tree built by pairing does: it adds no
    letter to the paths below it.
    """
    letter = "case when shiftright(pos, j - level) % 2 = 1 then 'R' when shiftright(pos, j - level) = shiftright(n - 1, j) then '' else 'L' end"
    path = F.expr(f"if(level < top, array_join(transform(reverse(sequence(level, top - 1)), j -> {letter}), ''), '')")
    leaf_pos = F.when(F.col("level") == 0, F.col("pos"))
    return tree(leaves, keys, order, leaf).where("real").select(*keys, path.alias("node_path"), "level", "hash", (F.col("level") == 0).alias("is_leaf"), leaf_pos.alias("leaf_pos"))


def leaves_of(tree: DataFrame, keys: list[str]) -> DataFrame:
    return tree.where("is_leaf").select(*keys, "leaf_pos", "hash")


def same_node(a: Column, b: Column) -> Column:
    """Nodes are equal if hash and leaf flag are."""
    return a["hash"].eqNullSafe(b["hash"]) & (a["is_leaf"] == b["is_leaf"])


def to_json(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    """keys and tree_json: the tree as nested JSON with hash, is_leaf, left and right. For export: a value holds a whole tree."""
    text = lambda h, flag, x, y: F.concat(F.lit('{"hash": "'), h, F.lit(f'", "is_leaf": {flag}, "left": '), x, F.lit(', "right": '), y, F.lit("}"))

    def both(x: Column, y: Column) -> Column:
        h = combine(x["hash"], y["hash"])
        return F.struct(h.alias("hash"), text(h, "false", x["text"], y["text"]).alias("text"))

    rows, most = _placed(leaves, keys, order, leaf)
    rows = rows.select(*keys, "pos", "n", F.struct("hash", text(F.col("hash"), "true", F.lit("null"), F.lit("null")).alias("text")).alias("node"))
    for _ in range(_rounds(most)):
        rows = _blocks(rows, keys, "node").select(*keys, "n", F.col("up").alias("pos"), _folded(F.col("l"), both).alias("node"))
    return rows.select(*keys, F.col("node.text").alias("tree_json"))


def from_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and a node table of each tree in JSON; text that holds no tree gives no nodes."""
    ship(rows.sparkSession)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [key, *(c.split()[0] for c in NODE.split(", "))]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64()]
        for b in batches:
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                found = parse(t)
                columns = [[k] * len(found), *(zip(*found) if found else [[]] * 5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, types)], names)

    return rows.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(read, f"{key} string, {NODE}")


def parse(text: str | None) -> list[tuple[str, int, str, bool, int | None]]:
    """(node_path, level, hash, is_leaf, leaf_pos) of a tree in JSON, root first; none if it isn't one."""
    out: list[list] = []

    def walk(node: dict, path: str, at: int) -> tuple[int, int]:
        """The node's level and the leaves up to its end."""
        row = [path, 0, node["hash"], node["is_leaf"], at if node["is_leaf"] else None]
        if not isinstance(row[2], str) or not isinstance(row[3], bool):
            raise TypeError("a node has a hash and a leaf flag")
        out.append(row)
        if row[3]:
            return 0, at + 1
        a, at = walk(node["left"], path + "L", at)
        b, at = walk(node["right"], path + "R", at)
        row[1] = max(a, b) + 1
        return row[1], at

    try:
        walk(json.loads(text), "", 0)
    except (TypeError, KeyError, ValueError, RecursionError):
        return []
    return [tuple(r) for r in out]
