"""The commands end to end on a small repository."""

import pytest

from chunkwell.errors import FormatMismatchError, UnsafePathError
from chunkwell.operators.integrity import ChunkIntegrityError
from chunkwell.plans.commands import Repository
from chunkwell.streaming.ingest import arrivals, ingest, read_stream

SIZES = (64, 256, 1024)


def put(root, **files):
    for name, data in files.items():
        (root / name).write_bytes(data)
    return list(files)


def make(spark, root):
    repo = Repository(spark, str(root), SIZES)
    repo.init()
    return repo


def test_add_commit_checkout_gc_and_sync(spark, tmp_path):
    import random

    r = random.Random(3)
    root = tmp_path / "a"
    root.mkdir()
    repo = make(spark, root)
    with pytest.raises(FileExistsError):
        repo.init()
    one, two = r.randbytes(9000), r.randbytes(300)
    names = put(root, one=one, two=two)
    stats = repo.add(repo.working_files(names)).first()
    assert stats.new_chunks == stats.chunks and stats.bytes == 9300
    assert repo.add(repo.working_files(names)).first().new_chunks == 0
    with pytest.raises(ValueError):
        repo.commit("  ")
    first = repo.commit("first", at=1.0)
    put(root, one=one[:5000] + b"edit" + one[5000:])
    assert 0 < repo.add(repo.working_files(["one"])).first().new_chunks <= 3
    second = repo.commit("second", at=2.0)
    changed = {(x.status): x["count"] for x in repo.delta(first, second).groupBy("status").count().collect()}
    assert changed["unchanged"] > changed["added"]
    assert [x.message for x in repo.log().collect()] == ["second", "first"]
    assert {x.path: bytes(x.content) for x in repo.read_files(first[:10]).collect()} == {"one": one, "two": two}
    assert {(x.path, x.size, x.size_ok) for x in repo.checkout(first[:10]).collect()} == {("one", 9000, True), ("two", 300, True)}
    assert (root / "one").read_bytes() == one
    counts = repo.fsck("stored").first()
    assert (counts.missing, counts.corrupt, counts.orphans) == (0, 0, 0)

    remote = str(tmp_path / "b")
    sent = repo.push(remote).first()
    assert sent.commits_synced == 2 and sent.skipped_chunks == 0 and not sent.used_merkle_delta
    again = repo.push(remote).first()
    assert (again.commits_synced, again.transferred_chunks) == (0, 0)
    other = tmp_path / "c"
    other.mkdir()
    clone = make(spark, other)
    assert clone.pull(remote).first().transferred_chunks == sent.transferred_chunks
    assert clone.log().count() == 2 and clone.checkout(second, write=False).count() == 2

    staged = put(root, three=r.randbytes(2000))
    repo.add(repo.working_files(staged))
    dry = repo.gc(dry_run=True).first()
    assert dry.deleted > 0 and repo.gc().first() == dry and repo.gc().first().deleted == 0
    objects = repo.catalog.read("objects")
    victim = objects.join(repo.refs_of(second).select("chunk_hash"), "chunk_hash", "left_semi").orderBy("chunk_hash").first().chunk_hash
    assert repo.delete_chunk(victim) and not repo.delete_chunk(victim)
    assert repo.fsck().first().missing == 1
    with pytest.raises(ChunkIntegrityError, match=victim[:12]):
        repo.checkout(second)


def test_branches_merge_and_rm(spark, tmp_path):
    repo = make(spark, tmp_path)
    with pytest.raises(ValueError):
        repo.branch("early")
    repo.add(repo.working_files(put(tmp_path, a=b"a" * 500)))
    repo.commit("base", at=1.0)
    repo.branch("side")
    with pytest.raises(ValueError):
        repo.branch("side")
    repo.switch("side")
    repo.add(repo.working_files(put(tmp_path, b=b"b" * 500)))
    repo.commit("side", at=2.0)
    repo.switch("main")
    (tmp_path / "b").rename(tmp_path / "kept")
    assert repo.merge("side")[0] == "fast-forward"
    (tmp_path / "kept").rename(tmp_path / "b")
    assert repo.merge("side")[0] == "up to date"
    repo.add(repo.working_files(put(tmp_path, c=b"c" * 500)))
    repo.commit("ours", at=3.0)
    repo.switch("side")
    repo.rm("c")
    repo.add(repo.working_files(put(tmp_path, d=b"d" * 500)))
    repo.commit("theirs", at=4.0)
    repo.switch("main")
    assert repo.merge("side", at=5.0)[0] == "merged"
    assert sorted(x.path for x in repo.checkout("main", write=False).collect()) == ["a", "b", "c", "d"]
    assert repo.log(branch="main").count() == 5
    repo.add(repo.working_files(put(tmp_path, a=b"x" * 500)))
    repo.commit("edit", at=6.0)
    repo.switch("side")
    repo.add(repo.working_files(put(tmp_path, a=b"y" * 500)))
    repo.commit("edit too", at=7.0)
    how, paths = repo.merge("main")
    assert how == "conflict" and [x.file_path for x in paths.collect()] == ["a"]
    with pytest.raises(ValueError):
        repo.branch("side", delete=True)
    repo.branch("main", delete=True)
    with pytest.raises(KeyError):
        repo.rm("nothing")
    with pytest.raises(UnsafePathError):
        repo.rm("../a")
    for bad in ("nope", "../../etc/passwd"):
        with pytest.raises((FileNotFoundError, UnsafePathError)):
            repo.working_files([bad])
    with pytest.raises(KeyError):
        repo.resolve("unknown")


def test_resolve_takes_a_unique_prefix_of_any_length(spark, tmp_path):
    repo = make(spark, tmp_path)
    repo.add(repo.working_files(put(tmp_path, a=b"x" * 500)))
    only = repo.commit("only", at=1.0)
    assert repo.resolve(only[:1]) == repo.resolve(only[:4]) == repo.resolve(only) == only


def test_signature_and_migrate(spark, tmp_path):
    repo = make(spark, tmp_path)
    repo.catalog.upsert("repo_meta", spark.createDataFrame([("chunker_min_size", "1")], "key string, value string"))
    with pytest.raises(FormatMismatchError, match="chunker_min_size"):
        repo.open()
    legacy = spark.createDataFrame([("ab" * 32, b"1"), ("cd" * 32, b"22")], "chunk_hash string, payload binary")
    assert repo.migrate(legacy, dry_run=True).first().migrated == 2 and repo.catalog.read("objects").count() == 0
    repo.migrate(legacy)
    assert tuple(repo.migrate(legacy).first()) == (2, 3) and repo.catalog.read("objects").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "in").mkdir()
    repo = make(spark, tmp_path / "r")
    put(tmp_path / "in", x=b"1" * 700, y=b"2" * 800)
    for _ in range(2):
        ingest(repo, read_stream(spark, str(tmp_path / "in")), str(tmp_path / "check"), once=True).awaitTermination()
        assert sorted(r.path for r in repo.catalog.read("files").collect()) == ["x", "y"]
    assert arrivals(read_stream(spark, str(tmp_path / "in"))).isStreaming


def on_disk(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_commit_stores_what_gc_took(spark, tmp_path):
    import random

    repo = make(spark, tmp_path)
    data = random.Random(1).randbytes(60_000)
    repo.add(repo.working_files(put(tmp_path, a=data)))
    full = on_disk(tmp_path / ".chunkwell/objects")
    gone = repo.gc().first()
    assert gone.deleted > 50 and gone.freed_bytes > 50_000
    assert on_disk(tmp_path / ".chunkwell/objects") < full - 50_000  # files are removed, not only left out
    commit = repo.commit("after gc", at=1.0)
    counts = repo.fsck("stored").first()
    assert (counts.missing, counts.corrupt, counts.orphans) == (0, 0, 0) and counts.referenced == gone.deleted
    (tmp_path / "a").unlink()
    repo.checkout(commit)
    assert (tmp_path / "a").read_bytes() == data
    before = on_disk(tmp_path / ".chunkwell/objects")
    assert repo.gc().first().deleted == 0 and on_disk(tmp_path / ".chunkwell/objects") == before


def test_commit_takes_the_working_folder_as_it_is(spark, tmp_path):
    repo = make(spark, tmp_path)
    put(tmp_path, a=b"old" * 100, b=b"b" * 100)
    (tmp_path / ".hidden").write_bytes(b"h" * 100)
    repo.add(repo.working_files(["a", "b", ".hidden"]))
    first = repo.commit("one", at=1.0)
    put(tmp_path, a=b"new" * 400, b=b"")
    second = repo.commit("edited, not added", at=2.0)
    assert {r.path: bytes(r.content) for r in repo.read_files(second).collect()} == {"a": b"new" * 400, "b": b"", ".hidden": b"h" * 100}
    assert {r.path: bytes(r.content) for r in repo.read_files(first).collect()}["a"] == b"old" * 100
    (tmp_path / "a").unlink()
    tables = {t: repo.catalog.read(t).count() for t in ("commits", "chunk_refs", "objects", "chunks", "merkle_nodes", "chunk_cache")}
    with pytest.raises(FileNotFoundError, match="a"):
        repo.commit("a file is gone", at=3.0)
    assert tables == {t: repo.catalog.read(t).count() for t in tables}
    repo.rm("a")
    third = repo.commit("without it", at=3.0)
    assert sorted(r.path for r in repo.checkout(third, write=False).collect()) == [".hidden", "b"]


def test_files_from_elsewhere_are_committed_as_added(spark, tmp_path):
    repo = make(spark, tmp_path)
    repo.add(spark.createDataFrame([("x/y", b"1" * 3000), ("z", b"2" * 50), ("none", None)], "path string, content binary"))
    with pytest.raises(FileNotFoundError):
        repo.commit("not in the folder")
    commit = repo.commit("as added", staged=True)
    assert {r.path: len(r.content) for r in repo.read_files(commit).collect()} == {"x/y": 3000, "z": 50}
    repo.delete_chunk(repo.refs_of(commit).first().chunk_hash)
    with pytest.raises(FileNotFoundError):
        repo.commit("a chunk is gone", staged=True)


def test_trees_refs_and_deleted_commits(spark, tmp_path):
    import json
    import random

    repo = make(spark, tmp_path)
    repo.add(repo.working_files(put(tmp_path, a=random.Random(2).randbytes(9000))))
    one = repo.commit("one", at=1.0)
    two = repo.commit("two", at=2.0)
    leaves = [r.chunk_hash for r in repo.refs_of(one).collect()]
    assert [r.hash for r in repo.tree(one).where("is_leaf").orderBy("leaf_pos").collect()] == leaves
    text = repo.export_tree(one)
    tree = json.loads(text)
    assert tree["hash"] == repo.catalog.read("commits").where(f"commit_hash = '{one}'").first().merkle_root_hash
    assert text == json.dumps(tree)  # the text that a plain JSON writer makes
    stored = sorted(map(tuple, repo.tree(one).collect()))
    repo.catalog.replace_partitions("merkle_nodes", [one])
    assert repo.export_tree(one) is None and repo.tree(two).count() == len(stored)
    for bad in ("", "{}", "[1]", '{"hash": "x", "is_leaf": false}', repo.export_tree(two).replace(tree["hash"], "0" * 64)):
        with pytest.raises(ValueError):
            repo.import_tree(one, bad)
    assert repo.import_tree(one, text) == len(stored) and sorted(map(tuple, repo.tree(one).collect())) == stored

    remote = str(tmp_path / "remote")
    assert not repo.push(remote).first().used_merkle_delta
    put(tmp_path, a=random.Random(3).randbytes(5000))
    three = repo.commit("three", at=3.0)
    sent = repo.push(remote).first()
    assert sent.used_merkle_delta and sent.commits_synced == 1
    far = Repository(spark, remote, SIZES).open()
    assert sorted(map(tuple, far.tree(three).collect())) == sorted(map(tuple, repo.tree(three).collect()))
    repo.set_ref("refs/heads/other", one)
    assert [r.name for r in repo.branches().collect()] == ["main", "other"]
    repo.set_ref("refs/heads/other", None)
    assert [r.name for r in repo.branches().collect()] == ["main"]
    assert repo.delete_commit(two) and not repo.delete_commit(two)
    assert repo.refs_of(two).count() == repo.tree(two).count() == 0 and repo.catalog.read("commit_parents").where(f"commit_hash = '{two}'").count() == 0
    assert repo.refs_of(three).count() > 0
    assert repo.cache_size() == repo.clear_cache() == 2 and repo.cache_size() == 0
    assert repo.commit("chunked again", at=4.0) and repo.cache_size() == 1


def test_changes_of_tables_are_whole_and_in_turn(spark, tmp_path):
    from chunkwell.errors import ConcurrentWriteError

    repo = make(spark, tmp_path)
    a, b = repo.catalog, Repository(spark, str(tmp_path), SIZES).catalog
    row = lambda k: spark.createDataFrame([(k, "1")], "key string, value string")
    mine, theirs = a.read("config"), b.read("config")
    a.replace("config", mine.unionByName(row("x")))
    with pytest.raises(ConcurrentWriteError):  # would lose x
        b.replace("config", theirs.unionByName(row("y")))
    b.replace("config", b.read("config").unionByName(row("y")))
    assert sorted(r.key for r in a.read("config").collect()) == ["x", "y"]
    live = tmp_path / ".chunkwell/config/live"
    last = max(int(p.name) for p in live.iterdir() if p.name.isdigit())
    (live / f"{last + 1:09d}.claim").write_text("")  # a writer that died before its rows counted
    (live / f"{last + 1:09d}.part").write_text("[")
    assert sorted(r.key for r in a.read("config").collect()) == ["x", "y"]
    with pytest.raises(ConcurrentWriteError, match="claim"):
        a.set_config("z", "1")
    (live / f"{last + 1:09d}.claim").unlink()
    (live / f"{last + 1:09d}.part").unlink()
    for i in range(3):
        a.set_config("z", str(i))
    assert a.config("z") == "2" and len([p for p in live.iterdir() if p.name.isdigit()]) == 2
    assert len(list((tmp_path / ".chunkwell/config/data").iterdir())) <= 4  # this one, the one before, and what the two refused writers left


def test_many_removals_keep_few_folders(spark, tmp_path):
    from chunkwell.sources import catalog

    repo = make(spark, tmp_path)
    rows = spark.createDataFrame([(f"{i:02x}", f"{i:02x}" * 32, 1, 1, b"x") for i in range(20)], "prefix string, chunk_hash string, raw_bytes bigint, stored_bytes bigint, payload binary")
    repo.catalog.append("objects", rows)
    for i in range(catalog.MAX_FOLDERS + 1):
        assert repo.delete_chunk(f"{i:02x}" * 32)
        assert repo.catalog.read("objects").count() == 19 - i
    assert len(repo.catalog._now("objects")[1]) < catalog.MAX_FOLDERS
    repo.catalog.append("objects", rows.where("prefix = '00'"))
    assert repo.catalog.read("objects").where("prefix = '00'").count() == 1
