"""The commands of a repository, each a few plans over its tables. They return DataFrames or small results."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import merkle, scalars
from ..operators import chunking, dag, delta, integrity, merge, metadata, store, sync
from ..sources.catalog import MARK, Catalog
from ..sources.session import mark, release, written

SIZES = (scalars.MIN_SIZE, scalars.AVG_SIZE, scalars.MAX_SIZE)


class Repository:
    """A working folder with its tables. files arguments are DataFrames (path, content), or (path, place) as of working_files().

    Executors open working files by themselves, so the folder must be one that they share.
    """

    def __init__(self, spark: SparkSession, root: str, sizes: tuple[int, int, int] = SIZES) -> None:
        self.spark, self.root, self.sizes = spark, root.rstrip("/"), sizes
        self.catalog = Catalog(spark, root)

    # ---- init, add, rm

    def init(self) -> None:
        if self.catalog.exists():
            raise FileExistsError(f"a repository already exists at {self.root}")
        self.catalog.create()

    def open(self) -> Repository:
        self.catalog.check()
        return self

    def working_files(self, paths: list[str]) -> DataFrame:
        """path (below the root), place of files of the working folder; errors for what can't be added."""
        found = {}
        for p in paths:
            name = scalars.to_repo_relative(Path(self.root) / p, self.root)
            place = scalars.safe_join(self.root, name)
            if not place.exists():
                raise FileNotFoundError(p)
            if place.is_dir() or place.stat().st_size == 0:
                raise ValueError(f"{p} is " + ("a folder" if place.is_dir() else "empty"))
            found[name] = str(place)
        return chunking.places(self.spark, found)

    def tracked_files(self) -> DataFrame:
        """path, place of every tracked file; UnsafePathError if one would lie outside the working folder."""
        files = self.catalog.read("files")
        tracked = metadata.list_files(files, "tracked")
        names = (files if tracked.isEmpty() else tracked).select("path")
        bad = names.where(~scalars.is_safe_path(F.col("path"))).first()
        if bad is not None:
            raise scalars.UnsafePathError(bad.path)
        root = str(Path(self.root).resolve())
        return names.select("path", F.concat(F.lit(root + "/"), "path").alias("place")).repartition("path")

    def _chunks(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """file_states() and chunk rows of files, each written once. What the boundary cache knows isn't cut again, and
        what it doesn't know goes there. FileNotFoundError, and nothing written, if a file isn't there."""
        c = self.catalog
        states = written(chunking.file_states(files), "states")
        gone = files.select("path").join(states, "path", "left_anti")
        if "place" in files.columns and (lost := gone.count()) > 0:
            names = ", ".join(r.path for r in gone.orderBy("path").limit(20).collect())
            raise FileNotFoundError(f"{lost} tracked files aren't in the working folder: {names}; restore them, or stop tracking them by rm")
        cached = metadata.cached_chunks(states, c.read("chunk_cache"))
        known = cached.where("cached is not null").select("path", F.posexplode("cached").alias("chunk_order", "k"))
        again = known.select("path", "chunk_order", F.col("k.offset").alias("chunk_offset"), F.col("k.length").alias("chunk_length"), F.col("k.hash").alias("chunk_hash"))
        todo = written(cached.where("cached is null").select("path", "file_hash", "size"), "todo")
        if todo.isEmpty():
            return states, written(again, "rows")
        rows = written(chunking.chunk_files(files.join(todo.select("path"), "path", "left_semi"), self.sizes, empty=True).unionByName(again), "rows")
        lists = rows.join(todo, "path").where("size > 0").groupBy("path", "file_hash", "size").agg(F.array_sort(F.collect_list(F.struct("chunk_order", F.col("chunk_hash").alias("hash"), F.col("chunk_offset").alias("offset"), F.col("chunk_length").alias("length")))).alias("l"))
        cache = lists.select("file_hash", F.transform("l", lambda x: F.struct(x["hash"].alias("hash"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("chunks"), F.col("size").alias("file_size"), F.size("l").alias("chunk_count"))
        c.ignore("chunk_cache", cache, "chunk_count")
        return states, rows

    def _store(self, files: DataFrame, rows: DataFrame) -> int:
        """Append the objects and records that are missing for chunk rows; how many objects. The anti join is of hashes
        alone: only bytes of missing chunks are read again, and only these reach the codec."""
        c = self.catalog
        first = rows.join(store.missing_from(rows, c.read("objects")), "chunk_hash").groupBy("chunk_hash").agg(F.min(F.struct("path", "chunk_offset", "chunk_length")).alias("f"))
        wanted = written(first.select("chunk_hash", "f.*"), "wanted")
        n = wanted.count()
        if n:
            c.append("objects", store.new_objects(chunking.pieces(files, wanted)))
        stored = c.read("objects").select("chunk_hash", "raw_bytes", "stored_bytes")
        lost = wanted.join(stored, "chunk_hash", "left_anti").first() if n else None
        if lost is not None:
            raise RuntimeError(f"{lost.path} changed while it was read")
        records = stored.join(rows.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
        c.ignore("chunks", records.select("chunk_hash", F.col("raw_bytes").alias("size_uncompressed"), F.col("stored_bytes").alias("size_compressed"), F.current_timestamp().alias("created_at")), "size_uncompressed")
        return n

    def add(self, files: DataFrame) -> DataFrame:
        """Store the missing chunks of files and track them; one row of what was new and reused.

        A file whose whole hash is in the boundary cache isn't chunked again.
        """
        since = mark(self.spark)
        states, rows = self._chunks(files)
        new = self._store(files, rows)
        total = rows.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("chunk_length"), F.lit(0)).alias("bytes")).first()
        now = F.lit(time.time())
        self.catalog.upsert("files", states.select("path", "file_hash", "size", now.alias("last_modified"), F.lit("tracked").alias("status"), F.current_timestamp().alias("updated_at")))
        release(self.spark, since)
        return self.spark.createDataFrame([(total.chunks, new, total.chunks - new, total.bytes)], "chunks bigint, new_chunks bigint, reused_chunks bigint, bytes bigint")

    def rm(self, path: str, recursive: bool = False) -> int:
        """Stop tracking a file, or with recursive all below a folder; how many. KeyError if nothing is there."""
        if ".." in path.split("/"):
            raise scalars.UnsafePathError(path)
        files = self.catalog.read("files")
        gone = files.where(F.col("path") == path)
        below = files.where(F.col("path").startswith(path.rstrip("/") + "/"))
        if gone.isEmpty():
            if below.isEmpty():
                raise KeyError(f"{path} isn't tracked")
            if not recursive:
                raise ValueError(f"{path} is a folder")
            gone = below
        n = gone.count()
        self.catalog.replace("files", metadata.delete(files, gone, ["path"]))
        return n

    # ---- commits

    def head(self) -> tuple[str, str | None]:
        """The current branch's ref name, and its commit or else the newest anywhere."""
        ref = self.catalog.config("HEAD", scalars.BRANCH_PREFIX + "main")
        row = self.catalog.read("refs").where(F.col("ref_name") == ref).first() or metadata.latest_commit(self.catalog.read("commits")).first()
        return ref, row.commit_hash if row else None

    def commit(self, message: str, author: str | None = None, at: float | None = None, staged: bool = False) -> str:
        """A snapshot of the tracked files as they are in the working folder now; its hash.

        Every file is hashed; one whose hash is in the boundary cache isn't cut, and chunks that the store lacks, also
        after gc, are stored. FileNotFoundError if a tracked file is gone: nothing is written then. staged: take files
        as they were added, for those that came from elsewhere; refused if the store lacks one of their chunks.
        """
        if not message.strip():
            raise ValueError("an empty message")
        since = mark(self.spark)
        if self.catalog.read("files").isEmpty():
            raise ValueError("nothing to commit")
        if staged:
            rows = self._staged()
        else:
            files = self.tracked_files()
            rows = self._chunks(files)[1]
            self._store(files, rows)
        commit = self._write_commit(rows, message, author, at, None)
        release(self.spark, since)
        return commit

    def _staged(self) -> DataFrame:
        c = self.catalog
        lists = metadata.list_files(c.read("files"), "tracked").join(c.read("chunk_cache"), "file_hash", "left").select("path", "chunks")
        rows = lists.select("path", F.posexplode_outer("chunks").alias("chunk_order", "k")).select("path", "chunk_order", F.col("k.hash").alias("chunk_hash"), F.col("k.offset").alias("chunk_offset"), F.col("k.length").alias("chunk_length"))
        rows = written(rows, "rows")
        lost = rows.join(c.read("objects").select("chunk_hash"), "chunk_hash", "left_anti").orderBy("path").first()
        if lost is not None:
            raise FileNotFoundError(f"{lost.path}: the store has not all of its chunks; add it again")
        return rows

    def _write_commit(self, rows: DataFrame, message: str, author: str | None, at: float | None, parents: list[str] | None) -> str:
        """References and the tree come first and the commit's row last, which makes it visible."""
        c = self.catalog
        ref, head = self.head()
        parents = parents if parents is not None else [head] if head else []
        at = time.time() if at is None else at
        numbered = written(metadata.numbered_refs(rows, ""), "refs")
        nodes = written(merkle.nodes(numbered, [], "ref_seq", "chunk_hash"), "nodes")
        top = nodes.where("node_path = ''").first()
        if top is None:
            raise ValueError("nothing to commit")
        spark, text, root = self.spark, repr(float(at)), top.hash
        commit = spark.range(1).select(scalars.commit_hash(F.lit(root), F.lit(message), F.lit(text), F.lit(parents[0] if parents else None)).alias("h")).first().h
        if not c.read("commits").where(F.col("commit_hash") == commit).isEmpty():
            raise ValueError(f"commit {commit[:12]} exists")
        self._clear([commit])  # of a commit that was begun and not ended
        c.append("chunk_refs", numbered.withColumn("commit_hash", F.lit(commit)))
        c.append("merkle_nodes", nodes.withColumn("commit_hash", F.lit(commit)))
        if parents:
            c.append("commit_parents", spark.createDataFrame([(commit, p, i) for i, p in enumerate(parents)], "commit_hash string, parent_hash string, ordinal int"))
        c.append("commits", spark.createDataFrame([(commit, parents[0] if parents else None, message, author, float(at), root)], "commit_hash string, parent_hash string, message string, author string, timestamp double, merkle_root_hash string"))
        c.upsert("refs", self._ref(ref, commit))
        if c.config("HEAD") != ref:
            c.set_config("HEAD", ref)
        return commit

    def _clear(self, commits: list[str]) -> None:
        """Take out what tables other than commits have of some commits."""
        c = self.catalog
        for name in ("chunk_refs", "merkle_nodes"):
            if not c.read(name).where(F.col("commit_hash").isin(commits)).isEmpty():
                c.replace_partitions(name, commits)
        parents = c.read("commit_parents")
        if not parents.where(F.col("commit_hash").isin(commits)).isEmpty():
            c.replace("commit_parents", parents.where(~F.col("commit_hash").isin(commits)))

    def delete_commit(self, commit: str) -> bool:
        """Take a commit's row out, then its references, tree and parents; whether it was there. Its chunks stay until gc."""
        commits = self.catalog.read("commits")
        there = not commits.where(F.col("commit_hash") == commit).isEmpty()
        if there:
            self.catalog.replace("commits", commits.where(F.col("commit_hash") != commit))
            self._clear([commit])
        return there

    def _ref(self, name: str, commit: str) -> DataFrame:
        return self.spark.createDataFrame([(name, commit)], "ref_name string, commit_hash string").withColumn("updated_at", F.current_timestamp())

    def set_ref(self, name: str, commit: str | None) -> None:
        """Let a ref name a commit; None deletes it."""
        if commit is None:
            self.catalog.replace("refs", self.catalog.read("refs").where(F.col("ref_name") != name))
        else:
            self.catalog.upsert("refs", self._ref(name, commit))

    def refs_of(self, commit: str) -> DataFrame:
        return metadata.commit_chunk_refs(self.catalog.read("chunk_refs"), commit)

    def tree(self, commit: str) -> DataFrame:
        """The stored tree of a commit as nodes; no rows if it has none."""
        return self.catalog.read("merkle_nodes").where(F.col("commit_hash") == commit)

    def export_tree(self, commit: str) -> str | None:
        """The tree as nested JSON; None without one."""
        row = merkle.to_json(merkle.leaves_of(self.tree(commit), []), [], "leaf_pos", "hash").first()
        return row.tree_json if row else None

    def import_tree(self, commit: str, text: str) -> int:
        """Store a tree from its JSON for a commit that has none; how many nodes. ValueError if it isn't the commit's."""
        known = metadata.by_key(self.catalog.read("commits"), "commit_hash", commit).first()
        nodes = merkle.parse(text)
        if known is None or not nodes or nodes[0][2] != known.merkle_root_hash:
            raise ValueError(f"no tree of commit {commit[:12]}")
        if self.tree(commit).isEmpty():
            rows = self.spark.createDataFrame([(commit, *n) for n in nodes], schemas.MERKLE_NODES)
            self.catalog.append("merkle_nodes", rows)
        return len(nodes)

    def delta(self, old: str, new: str) -> DataFrame:
        return delta.delta_by_set(self.refs_of(old), self.refs_of(new))

    def log(self, limit: int | None = None, branch: str | None = None) -> DataFrame:
        """All commits, newest first, or those that a branch reaches."""
        commits = self.catalog.read("commits")
        if branch is not None:
            head = self.catalog.read("refs").where(F.col("ref_name") == scalars.BRANCH_PREFIX + branch).select("commit_hash")
            commits = commits.join(dag.history(head, self.edges()).select("commit_hash"), "commit_hash", "left_semi")
        return metadata.list_commits(commits, limit)

    def edges(self) -> DataFrame:
        return metadata.commit_parents(self.catalog.read("commits"), self.catalog.read("commit_parents"))

    def resolve(self, ref: str) -> str:
        row = dag.resolve(self.spark.createDataFrame([(ref,)], "ref string"), self.catalog.read("refs"), self.catalog.read("commits"), least=1).first()
        if row.commit_hash is None:
            raise KeyError(f"{ref}: " + ("ambiguous" if row.n else "unknown"))
        return row.commit_hash

    def checkout(self, ref: str, write: bool = True) -> DataFrame:
        """path, size, size_ok of a commit's files; written to the working folder after every row proved right.

        A file is written chunk by chunk, in order, by one task, and renamed when it is whole: no row holds a file.
        """
        commit = self.resolve(ref)
        refs, objects = self.refs_of(commit), self.catalog.read("objects")
        known = written(integrity.measured(refs.select("chunk_hash"), objects), "measured")
        integrity.require_ok(known)
        files = written(integrity.restorable(refs, known), "files")
        if not files.where(~F.col("size_ok") | ~scalars.is_safe_path(F.col("path"))).isEmpty():
            raise integrity.ChunkIntegrityError(f"commit {commit[:12]} can't be restored")
        if write:
            data = store.retrieve(refs.select("chunk_hash").distinct(), objects, verify=True)
            rows = refs.select("file_path", "chunk_order", "chunk_hash").join(data, "chunk_hash").select("file_path", "chunk_order", "data")
            rows.repartition("file_path").sortWithinPartitions("file_path", "chunk_order").foreachPartition(_writer(str(Path(self.root).resolve())))
        return files

    def read_files(self, ref: str) -> DataFrame:
        """path, content, size_ok of a commit's files, each in a row: for files below 2 GB."""
        refs = self.refs_of(self.resolve(ref))
        return integrity.restore(refs, store.retrieve(refs.select("chunk_hash").distinct(), self.catalog.read("objects"), verify=True))

    # ---- branches, merge

    def branches(self) -> DataFrame:
        return metadata.list_branches(self.catalog.read("refs"))

    def branch(self, name: str, delete: bool = False) -> None:
        ref, (current, head) = scalars.BRANCH_PREFIX + name, self.head()
        refs = self.catalog.read("refs")
        there = not refs.where(F.col("ref_name") == ref).isEmpty()
        if delete:
            if ref == current:
                raise ValueError("the current branch can't be deleted")
            if not there:
                raise KeyError(name)
            self.catalog.replace("refs", refs.where(F.col("ref_name") != ref))
            return
        if there:
            raise ValueError(f"branch {name} exists")
        if head is None:
            raise ValueError("a branch needs a commit")
        self.catalog.upsert("refs", self._ref(ref, head))

    def switch(self, name: str) -> None:
        ref = scalars.BRANCH_PREFIX + name
        if self.catalog.read("refs").where(F.col("ref_name") == ref).isEmpty():
            raise KeyError(name)
        self.catalog.set_config("HEAD", ref)

    def merge(self, name: str, at: float | None = None) -> tuple[str, DataFrame | None]:
        """("up to date" | "fast-forward" | "merged" | "conflict", the conflicting paths or None)."""
        ref, ours = self.head()
        theirs = self.resolve(name)
        pairs = self.spark.createDataFrame([(ours, theirs), (theirs, ours)], "ancestor string, descendant string")
        known = {(r.ancestor, r.descendant): r.is_ancestor for r in dag.is_ancestor(pairs, self.edges()).collect()}  # two rows
        if known[(theirs, ours)]:
            return "up to date", None
        if known[(ours, theirs)]:
            self.catalog.upsert("refs", self._ref(ref, theirs))
            return "fast-forward", None
        a, b = self.refs_of(ours), self.refs_of(theirs)
        bad = merge.conflicts(a, b)
        if not bad.isEmpty():
            return "conflict", bad
        rows = merge.merged_refs(a, b).withColumnRenamed("file_path", "path")
        self._write_commit(rows, f"Merge branch '{name}'", None, at, [ours, theirs])
        return "merged", None

    # ---- upkeep

    def fsck(self, scope: str = "referenced") -> DataFrame:
        """Six counts; scope "stored" verifies every stored object, not only those that commits reference."""
        c = self.catalog
        active, objects = metadata.active_chunks(c.read("chunk_refs")), c.read("objects")
        verified = active if scope == "referenced" else active.union(objects.select("chunk_hash"))
        return integrity.fsck(active, c.read("chunks"), objects, integrity.scan(verified, objects))

    def _remove(self, gone: DataFrame) -> None:
        """Take objects out: only the store's partitions that hold one of them are written again, and their old files removed."""
        c = self.catalog
        prefixes = sorted(r.prefix for r in gone.select(F.substring("chunk_hash", 1, 2).alias("prefix")).distinct().collect())  # at most 256
        if prefixes:
            objects = c.read("objects").where(F.col("prefix").isin(prefixes))
            c.replace_partitions("objects", prefixes, objects.join(gone.select("chunk_hash"), "chunk_hash", "left_anti"))

    def gc(self, dry_run: bool = False) -> DataFrame:
        """deleted, freed_bytes; live is what any commit references, so staged chunks are garbage."""
        c, since = self.catalog, mark(self.spark)
        gone = written(store.garbage(c.read("objects"), metadata.active_chunks(c.read("chunk_refs"))).select("chunk_hash", "stored_bytes"), "garbage")
        rows = self.spark.createDataFrame(store.freed(gone).collect())
        if not dry_run:
            self._remove(gone)
            orphans = metadata.orphan_chunks(c.read("chunks"), c.read("chunk_refs"))
            if not orphans.isEmpty():
                c.replace("chunks", metadata.delete_chunk_records(c.read("chunks"), c.read("chunk_refs"), orphans))
        release(self.spark, since)
        return rows

    def delete_chunk(self, chunk_hash: str) -> bool:
        """Take an object out of the store, whatever references it; whether it was there."""
        gone = self.catalog.read("objects").where((F.col("prefix") == chunk_hash[:2]) & (F.col("chunk_hash") == chunk_hash)).select("chunk_hash")
        there = not gone.isEmpty()
        if there:
            self._remove(self.spark.createDataFrame([(chunk_hash,)], "chunk_hash string"))
        return there

    def cache_size(self) -> int:
        return self.catalog.read("chunk_cache").count()

    def clear_cache(self) -> int:
        """Forget all chunk boundaries; how many files' there were."""
        n = self.cache_size()
        self.catalog.replace("chunk_cache", self.catalog.read("chunk_cache").limit(0), purge=True)
        return n

    def migrate(self, legacy: DataFrame, dry_run: bool = False) -> DataFrame:
        """Take a flat store's objects (chunk_hash, payload) into the partitioned one; migrated, bytes. Only new ones are written."""
        objects = self.catalog.read("objects")
        rows = self.spark.createDataFrame(store.migrate(objects, legacy)[1].collect())
        if not dry_run:
            self.catalog.append("objects", store.migrated(objects, legacy))
        return rows

    # ---- sync

    def push(self, remote: str, commit: str | None = None, sync_refs: bool = False) -> DataFrame:
        target = Repository(self.spark, remote, self.sizes)
        target.catalog.create()
        return _transfer(self, target, commit, sync_refs)

    def pull(self, remote: str, commit: str | None = None, sync_refs: bool = False) -> DataFrame:
        return _transfer(Repository(self.spark, remote, self.sizes).open(), self, commit, sync_refs)


def _writer(root: str):
    """For foreachPartition: rows (file_path, chunk_order, data) in order of path and place, to files below root."""

    def put(rows) -> None:
        from itertools import groupby

        from chunkwell.functions.scalars import safe_join

        for path, parts in groupby(rows, lambda r: r.file_path):
            place = safe_join(root, path)
            place.parent.mkdir(parents=True, exist_ok=True)
            part = place.with_name(place.name + ".part")
            with open(part, "wb") as f:
                for r in parts:
                    f.write(r.data)
            part.replace(place)

    return put


def _transfer(source: Repository, target: Repository, commit: str | None, sync_refs: bool) -> DataFrame:
    """Objects first, then chunk records, references, trees and parents, and the commits' rows last."""
    s, t = source.catalog, target.catalog
    since = mark(target.spark)
    t.check()
    theirs = t.read("commits")
    mine = s.read("commits") if commit is None else s.read("commits").where(F.col("commit_hash") == source.resolve(commit))
    held = sync.leaves_or_refs(s.read("merkle_nodes"), s.read("chunk_refs"))
    if commit is None:
        wanted, used = sync.candidates(mine, held, theirs), sync.uses_trees(mine, theirs, s.read("merkle_nodes"))
    else:
        wanted, used = held.join(dag.missing_commits(mine, theirs).select("commit_hash"), "commit_hash", "left_semi").select("chunk_hash").distinct(), False
    actions = written(sync.plan(wanted, s.read("objects"), t.read("objects")), "actions")
    absent = actions.where("action = 'absent'").first()
    if absent is not None:
        raise FileNotFoundError(f"chunk {absent.chunk_hash[:12]} isn't in the source store")
    missing = written(dag.missing_commits(mine, theirs), "missing")
    stats = target.spark.createDataFrame(sync.stats(actions, store.object_sizes(s.read("objects")), missing, used).collect())  # one row
    t.append("objects", s.read("objects").join(actions.where("action = 'send'").select("chunk_hash"), "chunk_hash", "left_semi"))
    gone = missing.select("commit_hash")
    rows = s.read("chunk_refs").join(gone, "commit_hash", "left_semi")
    t.ignore("chunks", s.read("chunks").join(rows.select("chunk_hash"), "chunk_hash", "left_semi"), "size_uncompressed")
    begun = [r.commit_hash for r in t.read("chunk_refs").join(gone, "commit_hash", "left_semi").select("commit_hash").distinct().collect()]  # of transfers that didn't end
    if begun:
        target._clear(begun)
    t.append("chunk_refs", rows)
    t.append("merkle_nodes", s.read("merkle_nodes").join(gone, "commit_hash", "left_semi"))
    t.append("commit_parents", s.read("commit_parents").join(gone, "commit_hash", "left_semi"))
    t.append("commits", missing)
    if sync_refs:
        t.upsert("refs", s.read("refs"))
    release(target.spark, since)
    return stats


def find_root(start: str = ".") -> str | None:
    found = scalars.resolve_repo_root(start, MARK)
    return str(found) if found else None
