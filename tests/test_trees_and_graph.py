import hashlib
import random

import pytest

from chunkwell.errors import UnsafePathError
from chunkwell.functions import merkle, scalars
from chunkwell.operators import dag, delta, integrity, merge, metadata, store, sync

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
# Roots of leaves sha256("0"), sha256("1"), ..., first 16 digits.
ROOTS = {1: "5feceb66ffc86f38", 2: "fa13bb36c022a694", 3: "eada0514199238ae", 5: "a45a2925b7c95556", 7: "f55b87022c8cb64e", 8: "e11a20bae8379fdc", 9: "e0269c4d8130d117", 17: "5a87d41122fc3e3c", 33: "1d33d932e38921df", 2001: "13d8fe6d9a438de7"}


def leaves(spark, groups):
    return spark.createDataFrame([(g, i, h) for g, hs in groups.items() for i, h in enumerate(hs)], "g string, i int, chunk_hash string").repartition(3)


def tree(hashes):
    level = [(h, None, None) for h in hashes]
    while len(level) > 1:
        level = [(sha(level[i][0] + level[i + 1][0]), level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def walk(a, b, out):
    def below(n):
        return [n[0]] if n[1] is None else below(n[1]) + below(n[2])

    if a is None or b is None:
        for n, s in ((a, "removed"), (b, "added")):
            out.extend((s, h) for h in (below(n) if n else []))
    elif a[0] == b[0]:
        out.extend(("unchanged", h) for h in below(a))
    elif a[1] is None or b[1] is None:
        out.extend((("removed", a[0]), ("added", b[0])))
    else:
        walk(a[1], b[1], out)
        walk(a[2], b[2], out)
    return out


def test_roots_nodes_levels(spark):
    df = leaves(spark, {str(n): [sha(str(i)) for i in range(n)] for n in ROOTS})
    got = {int(r.g): r.merkle_root for r in merkle.roots(df, ["g"], "i", "chunk_hash").collect()}
    assert {n: h[:16] for n, h in got.items()} == ROOTS
    nodes = merkle.nodes(df, ["g"], "i", "chunk_hash").cache()
    assert {int(r.g): r.hash for r in nodes.where("node_path = ''").collect()} == got
    assert [r.hash for r in merkle.leaves_of(nodes.where("g = '33'"), ["g"]).orderBy("leaf_pos").collect()] == [sha(str(i)) for i in range(33)]
    assert nodes.where("g = '33'").count() == 65
    top = merkle.tree(df.where("g = '17'"), ["g"], "i", "chunk_hash").where("level = top")
    assert [(r.hash, r.pos, r.n) for r in top.collect()] == [(got[17], 0, 17)]
    for n in (1, 9, 2001):
        assert merkle.root(df.where(f"g = '{n}'"), "i", "chunk_hash")[:16] == ROOTS[n]
    assert merkle.root(df.limit(0), "i", "chunk_hash") is None
    none = spark.sql("SELECT cast(array() as array<string>) AS l").select(merkle.root_of(merkle.F.col("l")).alias("r")).first()
    assert none.r is None


def test_large_and_null_groups(spark):
    """More leaves than one round folds, in one hot group beside small ones, over many partitions."""
    hashes = {None: [sha(f"n{i}") for i in range(3)], "hot": [sha(f"h{i}") for i in range(70_001)], "one": [sha("1")], "edge": [sha(f"e{i}") for i in range(257)]}
    df = leaves(spark, hashes)

    def fold(level):
        while len(level) > 1:
            level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    want = {g: (len(hs), fold(hs)) for g, hs in hashes.items()}
    assert {r.g: (r.n_leaves, r.merkle_root) for r in merkle.roots(df, ["g"], "i", "chunk_hash").collect()} == want
    rows = merkle.nodes(df, ["g"], "i", "chunk_hash").cache()
    assert {r.g: r["count"] for r in rows.groupBy("g").count().collect()} == {g: 2 * len(hs) - 1 for g, hs in hashes.items()}
    assert {r.g: r.hash for r in rows.where("node_path = ''").collect()} == {g: h for g, (_, h) in want.items()}
    # every inner node is made of the two below its path
    a, b, c = rows.alias("a"), rows.alias("b"), rows.alias("c")
    F = merkle.F
    under = lambda x, letter: F.col("a.g").eqNullSafe(F.col(f"{x}.g")) & (F.concat("a.node_path", F.lit(letter)) == F.col(f"{x}.node_path"))
    pairs = a.where("not a.is_leaf").join(b, under("b", "L")).join(c, under("c", "R"))
    right = (merkle.combine(F.col("b.hash"), F.col("c.hash")) == F.col("a.hash")) & (F.col("a.level") == 1 + F.greatest("b.level", "c.level"))
    assert pairs.where(right).count() == rows.where("not is_leaf").count()


def test_trees_in_json(spark):
    import json

    groups = {str(n): [sha(str(i)) for i in range(n)] for n in (1, 2, 5, 300)}
    df = leaves(spark, groups)
    text = merkle.to_json(df, ["g"], "i", "chunk_hash").cache()
    shape = lambda t: t and {"hash": t[0], "is_leaf": t[1] is None, "left": shape(t[1]), "right": shape(t[2])}
    assert {r.g: r.tree_json for r in text.collect()} == {g: json.dumps(shape(tree(hs))) for g, hs in groups.items()}
    bad = spark.createDataFrame([("a", None), ("b", "x"), ("c", "{}"), ("d", '{"hash": 1, "is_leaf": true}'), ("e", "[" * 100_000)], "g string, tree_json string")
    back = merkle.from_json(text.unionByName(bad), "g", "tree_json")
    key = lambda rs: sorted(map(tuple, rs), key=str)
    assert key(back.collect()) == key(merkle.nodes(df, ["g"], "i", "chunk_hash").select(back.columns).collect())


def test_deltas(spark):
    r = random.Random(4)
    base = [sha(f"s{i}") for i in range(500)]
    old = {"same": base[:9], "front": [sha(str(i)) for i in range(257)], "cut": base[:300], "none": [], "gone": base[:3]}
    new = {"same": base[:9], "front": ["new", *old["front"]], "cut": base[:150], "none": base[:64], "gone": []}
    for k in range(12):
        old[f"r{k}"] = r.choices("abcdefgh", k=r.randint(1, 20))
        new[f"r{k}"] = [r.choice("abcdefgh") if r.random() < 0.3 else h for h in old[f"r{k}"]][: r.randint(1, 20)]
    a, b = leaves(spark, old), leaves(spark, new)
    for g in ("front", "cut", "none"):
        got = {x.status: x["count"] for x in delta.delta_by_set(a.where(f"g = '{g}'"), b.where(f"g = '{g}'")).groupBy("status").count().collect()}
        o, n = set(old[g]), set(new[g])
        assert got == {k: v for k, v in (("added", len(n - o)), ("removed", len(o - n)), ("unchanged", len(o & n))) if v}
    got = delta.delta_positional(*(merkle.nodes(x, ["g"], "i", "chunk_hash") for x in (a, b)), ["g"]).collect()
    for g in old:
        assert sorted((x.status, x.hash) for x in got if x.g == g) == sorted(walk(tree(old[g]), tree(new[g]), [])), g


def test_graph(spark):
    r = random.Random(5)
    edges = {f"c{i:03}": sorted({f"c{r.randrange(i):03}" for _ in range(r.choice([1, 1, 2]))}) for i in range(1, 120)} | {"x": ["y"], "y": ["x"]}
    df = spark.createDataFrame([(c, p) for c, ps in edges.items() for p in ps], "commit_hash string, parent_hash string")

    def reach(c, seen=None):
        seen = seen if seen is not None else set()
        if c not in seen:
            seen.add(c)
            for p in edges.get(c, []):
                reach(p, seen)
        return seen

    starts = ["c119", "c050", "x", "unknown"]
    got = {(x.start, x.commit_hash) for x in dag.history(spark.createDataFrame([(s,) for s in starts], "commit_hash string"), df).collect()}
    assert got == {(s, c) for s in starts for c in reach(s)}
    pairs = [("c000", "c119"), ("c119", "c000"), ("c050", "c050"), ("", "c001"), ("c001", None)]
    known = {(x.ancestor, x.descendant): x.is_ancestor for x in dag.is_ancestor(spark.createDataFrame(pairs, "ancestor string, descendant string"), df).collect()}
    assert known == {("c000", "c119"): True, ("c119", "c000"): False, ("c050", "c050"): True, ("", "c001"): False, ("c001", None): False}


def test_names(spark):
    commits = spark.createDataFrame([("abcdef11" * 8, 1.0), ("abcdef22" * 8, 2.0)], "commit_hash string, timestamp double")
    refs = spark.createDataFrame([("refs/heads/main", "h1"), ("refs/heads/abcdef", "h2")], "ref_name string, commit_hash string")
    wanted = spark.createDataFrame([("main",), ("refs/heads/main",), ("abcdef11" * 8,), ("abcdef2",), ("abcdef",), ("abcde",), ("abcdefx",)], "ref string")
    got = {r.ref: (r.commit_hash, r.n) for r in dag.resolve(wanted, refs, commits).collect()}
    assert got == {"main": ("h1", 1), "refs/heads/main": ("h1", 1), "abcdef11" * 8: ("abcdef11" * 8, 1), "abcdef2": ("abcdef22" * 8, 1), "abcdef": ("h2", 1), "abcde": (None, 0), "abcdefx": (None, 0)}
    assert dag.resolve(spark.createDataFrame([("abcdef",)], "ref string"), refs.limit(0), commits).first().n == 2
    assert [r.commit_hash[:8] for r in metadata.list_commits(commits, 1).collect()] == ["abcdef22"]


def test_short_names(spark):
    commits = spark.createDataFrame([("abcdef11" * 8,), ("abcdef22" * 8,), ("b0" * 32,), ("b0" * 32,)], "commit_hash string")
    refs = spark.createDataFrame([("refs/heads/a", "h1")], "ref_name string, commit_hash string")
    wanted = spark.createDataFrame([("a",), ("abcde",), ("abcdef1",), ("b",), ("b0b0",), ("c",), ("b" * 65,), ("b0" * 32,)], "ref string")
    got = {r.ref: (r.commit_hash, r.n) for r in dag.resolve(wanted, refs, commits, least=1).collect()}
    b = ("b0" * 32, 1)
    assert got == {"a": ("h1", 1), "abcde": (None, 2), "abcdef1": ("abcdef11" * 8, 1), "b": b, "b0b0": b, "c": (None, 0), "b" * 65: (None, 0), "b0" * 32: b}


BAD = ["..", "../x", "x/../../y", "x/y/..", "x\\..\\..\\y", "/x", "\\x\\y", "/", "D:x", "d:\\x\\y.bin", "e:/x", "a/b/../..", ""]


def test_paths(spark, tmp_path):
    df = spark.createDataFrame([(p,) for p in [*BAD, "x/y.bin", "x/y:z", "...", "x..y/..z"]], "p string")
    assert {r.p for r in df.where(scalars.is_safe_path(scalars.F.col("p"))).collect()} == {"x/y.bin", "x/y:z", "...", "x..y/..z"}
    for p in BAD:
        with pytest.raises(UnsafePathError):
            scalars.safe_join(tmp_path, p)
    assert scalars.safe_join(tmp_path, "a/b") == tmp_path.resolve() / "a/b"
    assert scalars.to_repo_relative(tmp_path / "x" / "y", tmp_path) == "x/y" and not scalars.is_within("/etc", tmp_path)


def test_formats(spark):
    from chunkwell.functions.scalars import F

    n = spark.createDataFrame([(0,), (1023,), (1024,), (1152,), (1536 << 10,), (3 << 40,), (5 << 60,)], "n bigint")
    assert [r[0] for r in n.select(scalars.format_bytes(F.col("n"))).collect()][:5] == ["0 bytes", "1023 bytes", "1.0 KB", "1.1 KB", "1.5 MB"]
    assert [r[0] for r in n.select(scalars.human_size(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.50 MB", "3.00 TB", "5120.00 PB"]
    import random

    r = random.Random(8)
    xs = [r.choice([r.random() * 10 ** r.randint(-3, 9), r.randrange(10**6) / 20, r.randrange(10**6) / 8, r.randrange(10**7) / 1000]) for _ in range(3000)]
    for digits in (0, 1, 2):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars._fixed(F.col("x"), digits)).collect()
        assert [(x, t) for x, t in got if t != f"{x:.{digits}f}"] == []
    s = spark.createDataFrame([(1.25,), (61.0,)], "s double")
    assert [r[0] for r in s.select(scalars.format_duration(F.col("s"))).collect()] == ["1.2s", "1m01s (61.0s)"]


def test_integrity_gc_and_layouts(spark):
    import zstandard

    z = zstandard.ZstdCompressor().compress
    h = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("good", "tampered", "cut", "garbage", "absent")}
    rows = [(h["good"], z(b"good")), (h["tampered"], z(b"other")), (h["cut"], z(b"cut" * 100)[:-4]), (h["garbage"], b"not zstd")]
    objects = spark.createDataFrame(rows, "chunk_hash string, payload binary").withColumn("prefix", integrity.F.substring("chunk_hash", 1, 2))
    active = spark.createDataFrame([(x,) for x in h.values()], "chunk_hash string")
    status = integrity.scan(active, objects)
    assert {r.chunk_hash: r.status for r in status.collect()} == {h["good"]: "ok", h["tampered"]: "corrupt", h["cut"]: "corrupt", h["garbage"]: "corrupt", h["absent"]: "missing"}
    with pytest.raises(integrity.ChunkIntegrityError):
        integrity.require_ok(status)
    kept, stats = store.collect_garbage(objects, active.where(f"chunk_hash = '{h['good']}'"))
    assert kept.count() == 1 and tuple(stats.first()) == (3, sum(len(p) for _, p in rows[1:]))
    legacy = spark.createDataFrame([rows[0], ("ee" * 32, b"zz")], "chunk_hash string, payload binary")
    after, moved = store.migrate(objects, legacy)
    assert after.count() == 5 and moved.first().migrated == 2  # the redundant flat copy counts
    found = store.resolve(active, objects, legacy)
    assert found.where("layout = 'canonical'").count() == 4 and found.where("layout is null").count() == 1


def test_merge_keeps_repeated_chunks(spark):
    cols = "file_path string, chunk_order int, chunk_hash string, chunk_length bigint"
    ours = spark.createDataFrame([("f", 0, "a", 2), ("f", 1, "a", 2), ("f", 2, "b", 3), ("g", 0, "x", 1)], cols)
    theirs = spark.createDataFrame([("f", 0, "a", 2), ("f", 1, "a", 2), ("f", 2, "b", 3), ("g", 0, "y", 1), ("n", 0, "z", 4)], cols)
    assert {r.file_path: r.side for r in merge.merge_paths(ours, theirs).collect()} == {"f": "both", "g": "conflict", "n": "theirs"}
    assert sorted(tuple(r) for r in merge.merged_refs(ours, theirs).collect()) == [("f", 0, "a", 0, 2), ("f", 1, "a", 2, 2), ("f", 2, "b", 4, 3), ("n", 0, "z", 0, 4)]


def test_sync_sends_chunks_of_commits_in_the_middle(spark):
    commits = spark.createDataFrame([("c1", 1.0), ("c2", 2.0), ("c3", 3.0)], "commit_hash string, timestamp double")
    refs = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "middle"), ("c3", "a"), ("c3", "new")], "commit_hash string, chunk_hash string")
    target = commits.where("commit_hash = 'c1'")
    assert sorted(r.chunk_hash for r in sync.candidates(commits, refs, target).collect()) == ["middle", "new"]
    assert sync.candidates(commits, refs, commits).count() == 0  # without missing commits nothing is offered, orphans neither
    has = lambda *hs: spark.createDataFrame([(x,) for x in hs], "chunk_hash string")
    plan = {r.chunk_hash: r.action for r in sync.plan(has("a", "b", "c"), has("a", "b"), has("a")).collect()}
    assert plan == {"a": "skip", "b": "send", "c": "absent"}


def test_writes(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, metadata.upsert(t, new, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, metadata.insert_or_ignore(t, new.unionAll(new.selectExpr("k", "v + 1")), ["k"], "v").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, metadata.latest_wins(t.unionAll(new), ["k"], "v").collect())) == [("a", 1), ("b", 9), ("c", 3)]
    commits = spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2")], "commit_hash string, parent_hash string")
    parents = spark.createDataFrame([("c3", "c1", 1), ("c3", "c2", 0)], "commit_hash string, parent_hash string, ordinal int")
    assert sorted(map(tuple, metadata.commit_parents(commits, parents).collect())) == [("c2", "c1", 0), ("c3", "c1", 1), ("c3", "c2", 0)]
