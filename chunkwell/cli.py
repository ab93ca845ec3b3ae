"""The command line: python -m chunkwell.cli COMMAND. Exit code 0 when done, 1 when refused, 2 for wrong usage."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .errors import ChunkIntegrityError
from .functions.cdc import backend_description
from .functions.scalars import format_bytes, format_duration, format_time, resolve_input_path, short_hash, subject, throughput


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunkwell", description="content-addressed versions of large files")
    p.add_argument("--root", default=".", help="the repository's folder")
    p.add_argument("--version", action="version", version=f"chunkwell {__version__}, chunks cut by {backend_description()}")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    a = sub.add_parser("add")
    a.add_argument("files", nargs="+")
    a = sub.add_parser("commit")
    a.add_argument("-m", "--message", required=True)
    a.add_argument("--author")
    a = sub.add_parser("log")
    a.add_argument("-n", type=int)
    a.add_argument("--branch")
    a = sub.add_parser("checkout")
    a.add_argument("ref")
    a = sub.add_parser("rm")
    a.add_argument("path")
    a.add_argument("-r", action="store_true")
    a = sub.add_parser("fsck")
    a.add_argument("--scope", choices=["referenced", "stored"], default="referenced")
    for name in ("gc", "migrate"):
        a = sub.add_parser(name)
        a.add_argument("--dry-run", action="store_true")
        if name == "migrate":
            a.add_argument("legacy", help="a Parquet table of chunk_hash and payload")
    a = sub.add_parser("branch")
    a.add_argument("name", nargs="?")
    a.add_argument("-d", action="store_true")
    for name in ("switch", "merge"):
        sub.add_parser(name).add_argument("name")
    for name in ("push", "pull"):
        a = sub.add_parser(name)
        a.add_argument("remote", nargs="?", default="origin")
        a.add_argument("--commit")
        a.add_argument("--refs", action="store_true")
    return p


def show(df: DataFrame) -> None:
    """All rows, as they come: tab-separated, after the names of the columns."""
    print(*df.columns, sep="\t")
    for r in df.toLocalIterator():
        print(*r, sep="\t")


def _input(path: str, root: str) -> str:
    """A path on the command line: below the current folder if it is there, else below the repository's."""
    found = resolve_input_path(path)
    return str(found) if found.exists() else f"{root}/{path}"


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    from .plans.commands import Repository, find_root

    if args.command == "init":
        Repository(spark, args.root).init()
        return 0
    root = find_root(args.root) or args.root
    repo = Repository(spark, root).open()
    began = time.time()
    if args.command == "add":
        stats = repo.add(repo.working_files([_input(p, root) for p in args.files]))
        took = F.lit(time.time() - began)
        show(stats.select("*", format_bytes(F.col("bytes")).alias("size"), format_duration(took).alias("took"), throughput(F.col("bytes"), took).alias("rate")))
    elif args.command == "commit":
        _, before = repo.head()
        commit = repo.commit(args.message, args.author)
        if before:
            show(repo.delta(before, commit).groupBy("status").agg(F.count("*").alias("chunks")).orderBy("status"))
        print(commit)
    elif args.command == "log":
        show(repo.log(args.n, args.branch).select(short_hash(F.col("commit_hash")).alias("commit"), format_time(F.col("timestamp")).alias("date"), "author", subject(F.col("message")).alias("message")))
    elif args.command == "checkout":
        show(repo.checkout(args.ref).select("path", "size_ok"))
    elif args.command == "rm":
        print(repo.rm(args.path, args.r), "files")
    elif args.command == "fsck":
        counts = repo.fsck(args.scope)
        show(counts)
        row = counts.first()
        return int(bool(row.missing or row.corrupt))
    elif args.command == "gc":
        show(repo.gc(args.dry_run))
    elif args.command == "migrate":
        show(repo.migrate(spark.read.parquet(args.legacy), args.dry_run))
    elif args.command == "branch":
        if args.name is None:
            show(repo.branches())
        else:
            repo.branch(args.name, args.d)
    elif args.command == "switch":
        repo.switch(args.name)
    elif args.command == "merge":
        how, paths = repo.merge(args.name)
        print(how)
        if paths is not None:
            show(paths)
            return 1
    elif args.command in ("push", "pull"):
        show(getattr(repo, args.command)(args.remote, args.commit, args.refs))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chunkwell").getOrCreate()
    try:
        return run(args, spark)
    except (ValueError, KeyError, OSError, RuntimeError, ChunkIntegrityError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
