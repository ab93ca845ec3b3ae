import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwell.functions.cdc import center_size, cuts, cuts_by_byte
from chunkwell.functions.scalars import gear_table
from chunkwell.operators import chunking, store

SMALL = (64, 256, 1024)


def test_gear_and_center():
    assert gear_table()[:4] == [1609362278, 1803989619, 1416846906, 1309098117]
    assert center_size(256, 64, 1024) == 160 and center_size(2 << 20, 512 << 10, 8 << 20) == 1310720


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([SMALL, (16, 64, 256), (1, 8, 40)]))
def test_cuts_equal_the_definition(data, sizes):
    found = cuts(data, *sizes)
    assert found == cuts_by_byte(data, *sizes)
    assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
    assert sum(n for _, n in found) == len(data)
    assert all(n <= sizes[2] for _, n in found) and all(n >= min(sizes[0], len(data)) for _, n in found[:-1])


@pytest.mark.parametrize("size", [1, 1024, 524287, 524288, 524289, 2 << 20, (8 << 20) + 7])
def test_default_sizes(size):
    data = random.Random(size).randbytes(200_000)
    data = (data * (size // len(data) + 1))[:size]
    found = cuts(data)
    assert sum(n for _, n in found) == size and (size > 512 << 10 or len(found) == 1)
    assert all(512 << 10 <= n <= 8 << 20 for _, n in found[:-1])


def test_an_edit_moves_few_cuts():
    data = random.Random(1).randbytes(60_000)
    a = {data[o : o + n] for o, n in cuts(data, *SMALL)}
    edited = data[:30_000] + b"edit" + data[30_000:]
    b = {edited[o : o + n] for o, n in cuts(edited, *SMALL)}
    assert len(b - a) <= 4


def test_chunk_rows(spark):
    r = random.Random(2)
    files = {"a": r.randbytes(5000), "b": b"x" * 64, "c": b"", "d": "é\n\nz\n".encode() * 30, "e": None}
    df = spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3)
    want = sorted((p, k, o, n, hashlib.sha256(c[o : o + n]).hexdigest()) for p, c in files.items() if c for k, (o, n) in enumerate(cuts_by_byte(c, *SMALL)))
    assert sorted(map(tuple, chunking.chunk_files(df, SMALL).collect())) == want
    assert sorted(map(tuple, chunking.boundaries(df, SMALL).collect())) == [w[:4] for w in want]
    assert chunking.contiguity(chunking.chunk_files(df, SMALL)).where("not contiguous").count() == 0
    chunking.cdc_udtf(spark, "cut_up", SMALL)
    df.where("path = 'a'").createOrReplaceTempView("one_file")
    assert spark.sql("SELECT c.* FROM one_file, LATERAL cut_up(content) c").count() == sum(w[0] == "a" for w in want)
    lines = chunking.line_chunks(df.where("path = 'd'"))
    assert b"".join(bytes(x.data) for x in lines.orderBy("chunk_order").collect()) == files["d"]
    assert chunking.chunk_files(df.limit(0), SMALL).count() == 0


def test_files_at_their_places(spark, tmp_path):
    r = random.Random(6)
    held = {"a": r.randbytes(300_000), "_b": b"", ".c": b"z" * 64}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    there = {name: str(tmp_path / name) for name in held}
    files = chunking.places(spark, there | {"gone": str(tmp_path / "gone")})
    assert {x.path: (x.file_hash, x.size) for x in chunking.file_states(files).collect()} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in held.items()}
    rows = chunking.chunk_files(files, SMALL, empty=True).cache()
    content = spark.createDataFrame(list(held.items()), "path string, content binary")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, chunking.chunk_files(content, SMALL, empty=True).collect()))
    assert [x.chunk_length for x in rows.where("path = '_b'").collect()] == [0] and chunking.chunk_files(files, SMALL).where("path = '_b'").count() == 0
    for source in (files, content):
        got = chunking.pieces(source, rows.drop("chunk_order")).collect()
        assert len(got) == rows.count() and all(hashlib.sha256(x.data).hexdigest() == x.chunk_hash for x in got)


def test_compress_only_what_is_missing(spark):
    import zstandard

    rows = spark.createDataFrame([("a", 0, "h1", b"one"), ("a", 1, "h2", b"two"), ("b", 0, "h2", b"two")], "path string, chunk_order int, chunk_hash string, data binary")
    known = spark.createDataFrame([("h1",)], "chunk_hash string")
    got = {(r.path, r.chunk_order): r.payload for r in chunking.process_chunks(rows, known).collect()}
    assert got["a", 0] is None and zstandard.decompress(bytes(got["a", 1])) == b"two"
    marks = {(r.path, r.chunk_order): r.is_new for r in chunking.new_or_reused(rows, known).collect()}
    assert marks == {("a", 0): False, ("a", 1): True, ("b", 0): False}
    objects = store.as_objects(chunking.process_chunks(rows))
    assert objects.count() == 2 and store.retrieve(rows.select("chunk_hash"), objects).where("data is null").count() == 0
    plan = chunking.process_chunks(rows, known)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")  # the codec is above the join
