"""The engine's tables, derived from the test tables by rule: two versions of a set of files, a commit graph, damage.

A document's text is a file; version 2 inserts a line in front of every tenth, drops every 17th and appends a line to
every 19th. An event is a commit of its user's branch, with the one before as parent, and every 25th has a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import line_chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.lit("doc/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """path, content (text) of a version."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if version == 1:
        return d.select(_path().alias("path"), F.col("text").alias("content"))
    name = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("EDIT "), name, F.lit("\n"), "text")).when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("\nTAIL "), name)).otherwise(F.col("text"))
    return d.where("doc_id % 17 != 0").select(_path().alias("path"), text.alias("content"))


def chunks(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Line chunks of a version, without data."""
    return line_chunks(files(spark, sf_dir, version)).drop("data")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_refs of the commits v1 and v2, without ref_seq."""
    both = chunks(spark, sf_dir, 1).withColumn("commit_hash", F.lit("v1")).unionAll(chunks(spark, sf_dir, 2).withColumn("commit_hash", F.lit("v2")))
    return both.select("commit_hash", F.col("path").alias("file_path"), "chunk_hash", "chunk_offset", "chunk_length", "chunk_order")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_hash, parent_hash, message, author, timestamp from events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("parent", F.lag("event_id").over(w))
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("commit_hash"), F.sha2(F.col("parent").cast("string"), 256).alias("parent_hash"), F.col("event_type").alias("message"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_parents: recorded for every 25th event only, whose second parent is the event seven before; others fall back to their own row."""
    c = commits(spark, sf_dir).where("event_id % 25 = 0")
    first = c.where("parent_hash is not null").select("commit_hash", "parent_hash", F.lit(0).alias("ordinal"))
    return first.unionAll(c.where("event_id >= 7").select("commit_hash", F.sha2((F.col("event_id") - 7).cast("string"), 256).alias("parent_hash"), F.lit(1).alias("ordinal")))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refs: a branch for each user, at its newest commit."""
    heads = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("head"))
    return heads.select(F.concat(F.lit("refs/heads/user"), F.col("user_id").cast("string")).alias("ref_name"), F.sha2(F.col("head").cast("string"), 256).alias("commit_hash"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_hash, data of a store of whole files of which some are damaged (doc_id % 29 = 0) and some are gone (% 31 = 0)."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id % 31 != 0").select(F.sha2("text", 256).alias("chunk_hash"), F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("data"))


#: The same in DuckDB's SQL, as common table expressions.
SQL = """
f1 AS (SELECT doc_id, 'doc/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, text AS content FROM documents),
f2 AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 0 THEN 'EDIT ' || doc_id || chr(10) || content WHEN doc_id % 19 = 0 THEN content || chr(10) || 'TAIL ' || doc_id ELSE content END AS content FROM f1 WHERE doc_id % 17 <> 0),
fa AS (SELECT 'v1' AS v, path, content FROM f1 UNION ALL SELECT 'v2', path, content FROM f2),
pa AS (SELECT v, path, unnest(string_split(content, chr(10))) AS piece, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n FROM fa),
da AS (SELECT v, path, i, piece || CASE WHEN i < n THEN chr(10) ELSE '' END AS data FROM pa),
ca AS (SELECT v, path, CAST(row_number() OVER w - 1 AS INT) AS chunk_order, CAST(sum(strlen(data)) OVER w - strlen(data) AS BIGINT) AS chunk_offset, CAST(strlen(data) AS BIGINT) AS chunk_length, sha256(data) AS chunk_hash
       FROM da WHERE data <> '' WINDOW w AS (PARTITION BY v, path ORDER BY i)),
c1 AS (SELECT * EXCLUDE v FROM ca WHERE v = 'v1'),
c2 AS (SELECT * EXCLUDE v FROM ca WHERE v = 'v2'),
refs AS (SELECT v AS commit_hash, path AS file_path, chunk_hash, chunk_offset, chunk_length, chunk_order FROM ca),
commits AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS commit_hash, sha256(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR)) AS parent_hash, event_type AS message, 'user' || user_id AS author, epoch_us(ts) AS micros, event_id FROM events),
parents AS (SELECT commit_hash, parent_hash, 0 AS ordinal FROM commits WHERE event_id % 25 = 0 AND parent_hash IS NOT NULL UNION ALL SELECT commit_hash, sha256(CAST(event_id - 7 AS VARCHAR)), 1 FROM commits WHERE event_id % 25 = 0 AND event_id >= 7),
branches AS (SELECT 'refs/heads/user' || user_id AS ref_name, sha256(CAST(max_by(event_id, (ts, event_id)) AS VARCHAR)) AS commit_hash FROM events GROUP BY user_id),
edges AS (SELECT commit_hash, parent_hash, ordinal FROM parents UNION ALL SELECT commit_hash, parent_hash, 0 FROM commits WHERE parent_hash IS NOT NULL AND commit_hash NOT IN (SELECT commit_hash FROM parents)),
stored AS (SELECT sha256(text) AS chunk_hash, CASE WHEN doc_id % 29 = 0 THEN text || '!' ELSE text END AS data FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) WHERE doc_id % 31 <> 0)
"""
