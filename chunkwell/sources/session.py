"""What every session needs: the package on the executors, and tables in the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Scratch tables of each application, in the order in which they were made.
_scratch: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once for an application, wherever it was imported from here."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets one of its own; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, on the list of what release() removes."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors don't matter."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def mark(spark: SparkSession) -> int:
    """For release(): how many scratch tables there have been."""
    return len(_scratch.setdefault(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Remove the scratch tables made since a mark, but for those in keep (as written() gave them), once nothing will read them again."""
    made, kept = _scratch.setdefault(spark.sparkContext.applicationId, []), {df.__dict__.get("_scratch") for df in keep}
    for i in range(since, len(made)):
        if made[i] and made[i] not in kept:
            remove(spark, made[i])
            made[i] = ""
