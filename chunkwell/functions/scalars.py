"""Scalar functions on columns: formats, hashes of commits, references, paths, the chunker's signature."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsafePathError

CHUNKER_ID = "chunkwell-gear-sha256-v1"
MIN_SIZE, AVG_SIZE, MAX_SIZE = 512 << 10, 2 << 20, 8 << 20
BRANCH_PREFIX = "refs/heads/"


def chunker_signature(sizes: tuple[int, int, int] = (MIN_SIZE, AVG_SIZE, MAX_SIZE)) -> dict[str, str]:
    return {"chunker_id": CHUNKER_ID, "chunker_min_size": str(sizes[0]), "chunker_avg_size": str(sizes[1]), "chunker_max_size": str(sizes[2])}


def _fixed(x: Column, digits: int) -> Column:
    """x with so many digits, rounded as printf does: by the number's exact value, halves to the even digit.

    format_string alone rounds the shortest decimal text. The product's rounding error, exact as a factor of ten has
    few bits, tells on which side of a half the number is.
    """
    x, y = x.cast("double"), 10.0**digits
    split = x * 134217729.0
    high = split - (split - x)
    t = x * y
    low, error = F.floor(t), (high * y - t) + (x - high) * y
    up = (t - low > 0.5) | ((t - low == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    return F.format_string(f"%.{digits}f", (low + up.cast("int")).cast("double") / y)


def format_bytes(n: Column) -> Column:
    """From a MiB `x.y MB`, from a KiB `x.y KB`, else `n bytes`."""
    return F.when(n >= 1 << 20, F.concat(_fixed(n / float(1 << 20), 1), F.lit(" MB"))).when(n >= 1 << 10, F.concat(_fixed(n / 1024.0, 1), F.lit(" KB"))).otherwise(F.format_string("%d bytes", n.cast("bigint")))


def format_duration(seconds: Column) -> Column:
    """Under a minute `x.ys`; else minutes and seconds with the same in brackets."""
    short = F.concat(_fixed(seconds, 1), F.lit("s"))
    return F.when(seconds < 60, short).otherwise(F.concat(F.format_string("%dm%02ds (", F.floor(seconds / 60), F.floor(seconds % 60)), short, F.lit(")")))


def human_size(n: Column) -> Column:
    """Two decimals with the largest unit that leaves 1 or more, from B to PB."""
    unit = F.least(F.when(n < 1024, F.lit(0)).otherwise(F.floor(F.log(2.0, n.cast("double")) / 10)).cast("int"), F.lit(5))
    exact = F.when(F.pow(F.lit(1024.0), unit + 1) <= n, F.least(unit + 1, F.lit(5))).otherwise(unit)
    return F.concat_ws(" ", _fixed(n / F.pow(F.lit(1024.0), exact), 2), F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB", "TB", "PB"])), exact + 1))


def throughput(n: Column, seconds: Column) -> Column:
    rate = n / seconds
    return F.when((seconds <= 0) | (n <= 0), F.lit("-")).when(rate >= 1 << 20, F.concat(_fixed(rate / float(1 << 20), 1), F.lit(" MB/s"))).when(rate >= 1 << 10, F.concat(_fixed(rate / 1024.0, 1), F.lit(" KB/s"))).otherwise(F.concat(_fixed(rate, 0), F.lit(" B/s")))


def format_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def short_hash(h: Column) -> Column:
    return F.left(h, F.lit(12))


def subject(message: Column) -> Column:
    return F.left(message, F.lit(50))


def commit_hash(root: Column, message: Column, timestamp_text: Column, parent: Column) -> Column:
    """SHA-256 of root:message:timestamp:first parent; the timestamp as text formatted on the driver."""
    return F.sha2(F.concat_ws(":", root, message, timestamp_text, F.coalesce(parent, F.lit(""))), 256)


def is_reference(ref: Column) -> Column:
    """Whether text may name a commit or branch: 6 to 64 hex digits, or a name of safe letters."""
    return ref.rlike("^[0-9a-fA-F]{6,64}$") | ref.rlike("^[A-Za-z0-9._/-]{1,255}$")


def branch_ref_name(name: Column) -> Column:
    return F.when(name.startswith(BRANCH_PREFIX), name).otherwise(F.concat(F.lit(BRANCH_PREFIX), name))


def short_branch_name(ref: Column) -> Column:
    return F.when(ref.startswith(BRANCH_PREFIX), F.substring(ref, len(BRANCH_PREFIX) + 1, 1 << 30)).otherwise(ref)


def object_path(h: Column) -> Column:
    """Where an object lies: a folder of its first two hex digits."""
    return F.concat_ws("/", F.substring(h, 1, 2), h)


def is_safe_path(path: Column) -> Column:
    """A stored path that stays below the root: relative, no drive in its first part, no part `..`."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.coalesce(
        (path != "") & ~path.startswith("/") & ~path.startswith("\\") & ~F.get(parts, F.lit(0)).contains(":") & ~F.exists(parts, lambda p: p == ".."),
        F.lit(False),
    )


def relative_path(path: Column, root: str) -> Column:
    """The part of a path below root, with forward slashes; null where it isn't below."""
    posix = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^file:/+", "/")
    base = root.rstrip("/") + "/"
    return F.when(posix.startswith(base), F.substring(posix, len(base) + 1, 1 << 30))


def safe_join(root: str | os.PathLike, stored: str) -> Path:
    """The absolute place of a stored path on the driver; UnsafePathError if it isn't below root."""
    parts = stored.replace("\\", "/").split("/")
    if not stored or stored[0] in "/\\" or ":" in parts[0] or ".." in parts:
        raise UnsafePathError(stored)
    base = Path(root).resolve()
    found = (base / "/".join(parts)).resolve()
    if not found.is_relative_to(base):
        raise UnsafePathError(stored)
    return found


def to_repo_relative(target: str | os.PathLike, root: str | os.PathLike) -> str:
    base, found = Path(root).resolve(), Path(target).resolve()
    if not found.is_relative_to(base):
        raise UnsafePathError(str(target))
    return found.relative_to(base).as_posix()


def is_within(path: str | os.PathLike, root: str | os.PathLike) -> bool:
    return Path(path).resolve().is_relative_to(Path(root).resolve())


def resolve_input_path(raw: str | os.PathLike) -> Path:
    """A path that a user gave, absolute: a relative one is below the current folder."""
    return Path(raw).absolute().resolve()


def resolve_repo_root(start: str | os.PathLike, mark: str = ".chunkwell") -> Path | None:
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / mark).is_dir()), None)


def gear_table() -> list[int]:
    """The chunker's 256 numbers, by rule: 31 bits of the SHA-256 of the byte's decimal text."""
    return [int(hashlib.sha256(str(b).encode()).hexdigest()[:8], 16) & 0x7FFFFFFF for b in range(256)]
