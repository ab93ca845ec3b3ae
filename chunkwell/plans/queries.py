"""One registered query for each operator, over the whole test tables, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import merkle, scalars
from ..functions.codec import compress, decompress
from ..operators import chunking, dag, delta, integrity, merge, metadata, store, sync
from ..sources.session import written
from .fixtures import SQL, branches, chunks, commits, files, parents, refs, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name; sql follows the fixtures' common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _binary(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    return files(spark, d, version).withColumn("content", F.col("content").cast("binary"))


def _hashes(spark: SparkSession, d: str, version: int) -> DataFrame:
    return chunks(spark, d, version).select("chunk_hash")


# ---- files, chunks, hashes


@query("SELECT path, sha256(content) AS file_hash FROM f1 WHERE content IS NOT NULL")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("content is not null").select("path", F.sha2("content", 256).alias("file_hash"))


@query("""SELECT path, regexp_extract(path, '[^/]+$') AS name, strlen(content) AS size,
    CASE WHEN strlen(content) < 1024 THEN printf('%.2f B', strlen(content) / 1.0) WHEN strlen(content) < 1048576 THEN printf('%.2f KB', strlen(content) / 1024.0) ELSE printf('%.2f MB', strlen(content) / 1048576.0) END AS size_text FROM f1 WHERE content IS NOT NULL""")
def file_info(spark: SparkSession, d: str) -> DataFrame:
    return chunking.file_info(files(spark, d).where("content is not null").select("path", F.octet_length("content").cast("bigint").alias("length")))


#: Content-defined chunks of sizes 64, 256 and 1024, byte by byte: r walks, cdc has the chunks.
_CDC = """
, gear AS (SELECT list(CAST(concat('0x', left(sha256(CAST(b AS VARCHAR)), 8)) AS BIGINT) & 2147483647 ORDER BY b) AS g FROM range(256) t(b)),
bytes AS (SELECT path, hex(content) AS h, strlen(content) AS n FROM f1 WHERE content IS NOT NULL AND content <> ''),
r AS (
    SELECT path, h, n, 0 AS i, 0 AS s, CAST(0 AS BIGINT) AS p, 0 AS cut FROM bytes
    UNION ALL
    SELECT path, h, n, CASE WHEN done THEN j ELSE j END, CASE WHEN done THEN j ELSE s END, CASE WHEN done THEN 0 ELSE q END, CASE WHEN done THEN j - s ELSE 0 END
    FROM (
        SELECT *, j = n OR j - s = 1024 OR (j - s > 64 AND q & (CASE WHEN j - s - 1 < 160 THEN 511 ELSE 127 END) = 0) AS done
        FROM (
            SELECT path, h, n, s, j, CASE WHEN j - s <= 64 THEN 0 ELSE (p >> 1) + (SELECT g FROM gear)[CAST(concat('0x', substr(h, CAST(2 * j - 1 AS BIGINT), 2)) AS INT) + 1] END AS q
            FROM (SELECT *, CASE WHEN i = s THEN least(i + 64, n) ELSE i + 1 END AS j FROM r WHERE i < n)))),
cdc AS (
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INT) AS chunk_order, CAST(i - cut AS BIGINT) AS chunk_offset, CAST(cut AS BIGINT) AS chunk_length,
           sha256(unhex(substr(h, 2 * (i - cut) + 1, 2 * cut))) AS chunk_hash
    FROM r WHERE cut > 0)
"""


@query(f"{_CDC} SELECT path, chunk_order, chunk_offset, chunk_length FROM cdc", recursive=True)
def cdc_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return chunking.boundaries(_binary(spark, d), chunking.SMALL)


@query(f"{_CDC} SELECT path, chunk_order, chunk_offset, chunk_length, chunk_hash FROM cdc", recursive=True)
def cdc_chunk_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_files(_binary(spark, d), chunking.SMALL)


_SUMMARY = "count(DISTINCT path) AS files, count(*) AS chunks, count(DISTINCT chunk_hash) AS unique_chunks, CAST(sum(chunk_length) AS BIGINT) AS raw_bytes"
_BY_LANG = f"""SELECT a.lang, files, chunks, unique_chunks, raw_bytes, unique_bytes, round(100.0 * (chunks - unique_chunks) / chunks, 4) AS dedup_percent
    FROM (SELECT split_part(path, '/', 2) AS lang, {_SUMMARY} FROM {{0}} GROUP BY 1) a
    JOIN (SELECT lang, CAST(sum(l) AS BIGINT) AS unique_bytes FROM (SELECT split_part(path, '/', 2) AS lang, chunk_hash, max(chunk_length) AS l FROM {{0}} GROUP BY 1, 2) GROUP BY 1) b ON a.lang = b.lang"""


def _lang(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lang", F.get(F.split("path", "/"), F.lit(1)))


@query(_CDC + _BY_LANG.format("cdc"), recursive=True)
def cdc_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: content-defined chunks of all documents, deduplicated by language."""
    return chunking.dedup_summary(_lang(chunking.chunk_files(_binary(spark, d), chunking.SMALL)), "lang")


_CONTIGUOUS = "SELECT path, count(*) AS chunks, CAST(sum(chunk_length) AS BIGINT) AS bytes, bool_and(ok) AS contiguous FROM (SELECT *, chunk_offset = coalesce(lag(chunk_offset + chunk_length) OVER (PARTITION BY path ORDER BY chunk_order), 0) AS ok FROM {0}) GROUP BY path"


@query(_CDC + _CONTIGUOUS.format("cdc"), recursive=True)
def cdc_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return chunking.contiguity(chunking.boundaries(_binary(spark, d), chunking.SMALL))


@query(f"{_CDC} SELECT path, chunk_order, chunk_offset, chunk_length, chunk_hash FROM cdc", recursive=True)
def cdc_table_function(spark: SparkSession, d: str) -> DataFrame:
    chunking.cdc_udtf(spark)
    chunking.spread(_binary(spark, d).where("content is not null")).createOrReplaceTempView("cdc_files")
    return spark.sql("SELECT path, c.* FROM cdc_files, LATERAL cdc(content) c")


@query("SELECT path, 0 AS chunk_order, CAST(0 AS BIGINT) AS chunk_offset, CAST(strlen(content) AS BIGINT) AS chunk_length FROM f1 WHERE content IS NOT NULL AND content <> ''")
def small_file_single_chunk(spark: SparkSession, d: str) -> DataFrame:
    return chunking.boundaries(_binary(spark, d))


@query("SELECT * FROM c1")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


@query(_CONTIGUOUS.format("c1"))
def chunk_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return chunking.contiguity(chunks(spark, d))


@query("SELECT path, sha256(unhex(substr(hex(content), 21, 40))) AS piece FROM f1 WHERE content IS NOT NULL")
def read_chunk_at(spark: SparkSession, d: str) -> DataFrame:
    return chunking.read_chunk_at(files(spark, d).where("content is not null"), 10, 20).select("path", F.sha2("data", 256).alias("piece"))


@query("SELECT path, sha256(content) AS file_hash, strlen(content) AS size FROM f1 WHERE content IS NOT NULL")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    return chunking.file_states(files(spark, d))


@query("SELECT chunk_hash, sha256(data) AS data_hash FROM (SELECT chunk_hash, min(data) AS data FROM (SELECT chunk_hash, unhex(substr(hex(content), CAST(2 * chunk_offset + 1 AS BIGINT), CAST(2 * chunk_length AS BIGINT))) AS data FROM c1 JOIN f1 USING (path)) GROUP BY chunk_hash)")
def chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each distinct chunk, read again from the first file that has it."""
    first = chunks(spark, d).groupBy("chunk_hash").agg(F.min(F.struct("path", "chunk_offset", "chunk_length")).alias("f")).select("chunk_hash", "f.*")
    return chunking.pieces(_binary(spark, d), first).select("chunk_hash", F.sha2("data", 256).alias("data_hash"))


@query(_BY_LANG.format("c1"))
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.dedup_summary(_lang(chunks(spark, d)), "lang")


@query("SELECT chunk_hash, count(*) AS copies, max(chunk_length) AS chunk_length FROM c1 GROUP BY 1 ORDER BY copies DESC, chunk_hash LIMIT 20")
def dedup_top_shared(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("chunk_hash").agg(F.count("*").alias("copies"), F.max("chunk_length").alias("chunk_length")).orderBy(F.col("copies").desc(), "chunk_hash").limit(20)


@query("SELECT CAST(floor(log2(chunk_length)) AS INT) AS bucket, count(*) AS chunks, CAST(sum(chunk_length) AS BIGINT) AS bytes FROM c1 GROUP BY 1")
def chunk_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.floor(F.log2(F.col("chunk_length").cast("double"))).cast("int")
    return chunks(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("chunks"), F.sum("chunk_length").alias("bytes"))


# ---- object store


@query("""SELECT path, chunk_order, chunk_hash, row_number() OVER (PARTITION BY chunk_hash ORDER BY path, chunk_order) = 1 AND chunk_hash NOT IN (SELECT chunk_hash FROM c1) AS is_new FROM c2""")
def store_new_vs_reused(spark: SparkSession, d: str) -> DataFrame:
    return chunking.new_or_reused(chunks(spark, d, 2), chunks(spark, d, 1)).select("path", "chunk_order", "chunk_hash", "is_new")


@query("SELECT DISTINCT chunk_hash FROM c2 WHERE chunk_hash NOT IN (SELECT chunk_hash FROM c1)")
def store_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.missing_from(_hashes(spark, d, 2), _hashes(spark, d, 1))


@query("SELECT chunk_hash FROM (SELECT DISTINCT chunk_hash FROM c2) WHERE chunk_hash IN (SELECT chunk_hash FROM c1)")
def store_present(spark: SparkSession, d: str) -> DataFrame:
    return store.present_in(_hashes(spark, d, 2).distinct(), _hashes(spark, d, 1))


@query("SELECT DISTINCT chunk_hash, left(chunk_hash, 2) || '/' || chunk_hash AS path FROM c1")
def object_paths(spark: SparkSession, d: str) -> DataFrame:
    return store.list_objects(_hashes(spark, d, 1).distinct())


@query("SELECT left(chunk_hash, 2) AS prefix, count(DISTINCT chunk_hash) AS objects FROM c1 GROUP BY 1")
def fanout_buckets(spark: SparkSession, d: str) -> DataFrame:
    return store.fanout(_hashes(spark, d, 1).distinct())


def _layouts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = stored(spark, d).withColumn("payload", F.col("data").cast("binary")).withColumn("prefix", F.substring("chunk_hash", 1, 2))
    return s.where("prefix < 'b0'").drop("data"), s.where("prefix >= 'a0'").drop("data", "prefix")


@query("SELECT chunk_hash, CASE WHEN left(chunk_hash, 2) < 'b0' THEN 'canonical' ELSE 'legacy' END AS layout, strlen(data) AS stored_bytes FROM stored")
def resolve_layout(spark: SparkSession, d: str) -> DataFrame:
    canonical, legacy = _layouts(spark, d)
    found = store.resolve(stored(spark, d).select("chunk_hash"), canonical, legacy)
    return found.select("chunk_hash", "layout", F.octet_length("payload").cast("bigint").alias("stored_bytes"))


@query("SELECT count(*) AS migrated, CAST(sum(strlen(data)) AS BIGINT) AS bytes FROM stored WHERE left(chunk_hash, 2) >= 'a0'")
def migrate_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.migrate(*_layouts(spark, d))[1]


@query("SELECT left(chunk_hash, 2) AS prefix, chunk_hash FROM stored")
def migrate_layout(spark: SparkSession, d: str) -> DataFrame:
    return store.migrate(*_layouts(spark, d))[0].select("prefix", "chunk_hash")


@query("SELECT path, sha256(content) AS raw_hash, true AS same FROM f1 WHERE content IS NOT NULL")
def zstd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    chunking.ship(spark)
    rows = _binary(spark, d).where("content is not null").withColumn("payload", compress(F.col("content"))).withColumn("raw", decompress(F.col("payload")))
    return rows.select("path", F.sha2("raw", 256).alias("raw_hash"), (F.col("raw") == F.col("content")).alias("same"))


@query("SELECT path, chunk_order, chunk_hash, CASE WHEN chunk_hash NOT IN (SELECT chunk_hash FROM c1) THEN chunk_hash END AS payload_hash FROM c2")
def process_chunks(spark: SparkSession, d: str) -> DataFrame:
    """payload_hash: of the bytes that come back out of a payload; null where no payload was made."""
    done = chunking.process_chunks(chunking.line_chunks(files(spark, d, 2)), chunks(spark, d, 1))
    return done.select("path", "chunk_order", "chunk_hash", F.sha2(decompress(F.col("payload")), 256).alias("payload_hash"))


@query("SELECT chunk_hash, strlen(data) AS stored_bytes FROM stored")
def object_sizes(spark: SparkSession, d: str) -> DataFrame:
    return store.object_sizes(stored(spark, d).withColumn("payload", F.col("data").cast("binary")))


@query("SELECT k.h AS chunk_hash, CASE WHEN sha256(data) = k.h THEN strlen(data) END AS size FROM (SELECT DISTINCT sha256(content) AS h FROM f1 WHERE content IS NOT NULL) k LEFT JOIN stored ON stored.chunk_hash = k.h")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Verified bytes of every file; none where the store lacks it or has something else."""
    objects = stored(spark, d).select("chunk_hash", compress(F.col("data").cast("binary")).alias("payload"))
    wanted = _manifest(spark, d).select(F.col("file_hash").alias("chunk_hash")).distinct()
    return store.retrieve(wanted, objects, verify=True).select("chunk_hash", F.octet_length("data").cast("bigint").alias("size"))


# ---- Merkle trees and deltas


def _by_lang(spark: SparkSession, d: str, version: int) -> DataFrame:
    """The file hashes of each language, in order of path: the leaves of a tree."""
    return files(spark, d, version).where("content is not null").select(F.get(F.split("path", "/"), F.lit(1)).alias("lang"), "path", F.sha2("content", 256).alias("chunk_hash"))


_LEAVES = """leaf AS (SELECT split_part(path, '/', 2) AS lang, v, row_number() OVER (PARTITION BY v, split_part(path, '/', 2) ORDER BY path) - 1 AS pos, sha256(content) AS hash FROM fa WHERE content IS NOT NULL),
lv AS (
    SELECT lang, v, 0 AS k, pos, hash, max(pos) OVER (PARTITION BY lang, v) AS last FROM leaf
    UNION ALL
    SELECT lang, v, k + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE min(hash) END, min(last) // 2 FROM lv WHERE last > 0 GROUP BY lang, v, k, pos // 2)"""


@query(f", {_LEAVES} SELECT lang, n_leaves, hash AS merkle_root FROM lv JOIN (SELECT lang, v, count(*) AS n_leaves FROM leaf GROUP BY 1, 2) USING (lang, v) WHERE v = 'v1' AND last = 0", recursive=True)
def merkle_root_per_lang(spark: SparkSession, d: str) -> DataFrame:
    return merkle.roots(_by_lang(spark, d, 1), ["lang"], "path", "chunk_hash")


@query(f", {_LEAVES} SELECT lang, k AS level, pos, hash FROM lv WHERE v = 'v1'", recursive=True)
def merkle_levels(spark: SparkSession, d: str) -> DataFrame:
    return merkle.tree(_by_lang(spark, d, 1), ["lang"], "path", "chunk_hash").select("lang", "level", "pos", "hash")


#: Nodes by their paths, walked down from the roots: an only child takes its parent's place.
_NODES = f"""{_LEAVES},
lw AS (SELECT lang, v, k, pos, hash, last FROM lv),
pt AS (
    SELECT lang, v, k, pos, last, '' AS path FROM lw WHERE last = 0
    UNION ALL
    SELECT lw.lang, lw.v, lw.k, lw.pos, lw.last, pt.path || CASE WHEN 2 * pt.pos = lw.last THEN '' WHEN lw.pos % 2 = 0 THEN 'L' ELSE 'R' END
    FROM pt JOIN lw ON lw.lang = pt.lang AND lw.v = pt.v AND lw.k = pt.k - 1 AND lw.pos // 2 = pt.pos),
nd AS (
    SELECT pt.lang, pt.v, pt.path AS node_path, pt.k AS level, lw.hash, pt.k = 0 AS is_leaf, CASE WHEN pt.k = 0 THEN pt.pos END AS leaf_pos
    FROM pt JOIN lw ON lw.lang = pt.lang AND lw.v = pt.v AND lw.k = pt.k AND lw.pos = pt.pos
    LEFT JOIN lw c ON c.lang = pt.lang AND c.v = pt.v AND c.k = pt.k - 1 AND c.pos = 2 * pt.pos + 1
    WHERE pt.k = 0 OR c.pos IS NOT NULL)"""
_NODE_ROWS = f", {_NODES} SELECT lang, node_path, level, hash, is_leaf, leaf_pos FROM nd WHERE v = 'v1'"


def _tree(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    return merkle.nodes(_by_lang(spark, d, version), ["lang"], "path", "chunk_hash")


@query(_NODE_ROWS, recursive=True)
def merkle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)


@query(f""", {_LEAVES},
js AS (
    SELECT lang, k, pos, hash, last, '{{"hash": "' || hash || '", "is_leaf": true, "left": null, "right": null}}' AS t FROM lv WHERE v = 'v1' AND k = 0
    UNION ALL
    SELECT lang, k + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE min(hash) END, min(last) // 2,
           CASE WHEN count(*) = 2 THEN '{{"hash": "' || sha256(string_agg(hash, '' ORDER BY pos)) || '", "is_leaf": false, "left": ' || string_agg(t, ', "right": ' ORDER BY pos) || '}}' ELSE min(t) END
    FROM js WHERE last > 0 GROUP BY lang, k, pos // 2)
SELECT lang, t AS tree_json FROM js WHERE last = 0""", recursive=True)
def merkle_tree_json(spark: SparkSession, d: str) -> DataFrame:
    return merkle.to_json(_by_lang(spark, d, 1), ["lang"], "path", "chunk_hash")


@query(_NODE_ROWS, recursive=True)
def merkle_tree_from_json(spark: SparkSession, d: str) -> DataFrame:
    return merkle.from_json(merkle_tree_json(spark, d), "lang", "tree_json")


@query(f", {_LEAVES} SELECT lang, pos AS leaf_pos, hash FROM leaf WHERE v = 'v1'", recursive=True)
def merkle_leaf_order(spark: SparkSession, d: str) -> DataFrame:
    return merkle.leaves_of(_tree(spark, d), ["lang"])


@query("SELECT CASE WHEN a.chunk_hash IS NULL THEN 'added' WHEN b.chunk_hash IS NULL THEN 'removed' ELSE 'unchanged' END AS status, coalesce(a.chunk_hash, b.chunk_hash) AS chunk_hash FROM (SELECT DISTINCT chunk_hash FROM c1) a FULL JOIN (SELECT DISTINCT chunk_hash FROM c2) b ON a.chunk_hash = b.chunk_hash")
def delta_by_set(spark: SparkSession, d: str) -> DataFrame:
    return delta.delta_by_set(_hashes(spark, d, 1), _hashes(spark, d, 2))


@query(f""", {_NODES},
o AS (SELECT * FROM nd WHERE v = 'v1'), w AS (SELECT * FROM nd WHERE v = 'v2'),
st AS (
    SELECT o.lang, o.node_path, o.hash AS oh, w.hash AS nh, o.is_leaf AS ol, w.is_leaf AS nl FROM o JOIN w USING (lang, node_path) WHERE node_path = ''
    UNION ALL
    SELECT o.lang, o.node_path, o.hash, w.hash, o.is_leaf, w.is_leaf FROM st JOIN o ON o.lang = st.lang AND o.node_path IN (st.node_path || 'L', st.node_path || 'R') JOIN w ON w.lang = o.lang AND w.node_path = o.node_path
    WHERE st.oh <> st.nh AND NOT st.ol AND NOT st.nl)
SELECT lang, 'removed' AS status, oh AS hash, ol AS is_leaf FROM st WHERE oh <> nh AND (ol OR nl)
UNION ALL SELECT lang, 'added', nh, nl FROM st WHERE oh <> nh AND (ol OR nl)
UNION ALL SELECT o.lang, 'unchanged', o.hash, true FROM st JOIN o ON o.lang = st.lang AND starts_with(o.node_path, st.node_path) AND o.is_leaf WHERE st.oh = st.nh
UNION ALL SELECT lang, 'removed', hash, true FROM o WHERE is_leaf AND lang NOT IN (SELECT lang FROM w)
UNION ALL SELECT lang, 'added', hash, true FROM w WHERE is_leaf AND lang NOT IN (SELECT lang FROM o)""", recursive=True)
def delta_positional(spark: SparkSession, d: str) -> DataFrame:
    return delta.delta_positional(written(_tree(spark, d, 1), "nodes"), written(_tree(spark, d, 2), "nodes"), ["lang"])


# ---- metadata reads


def _manifest(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    f = files(spark, d, version).where("content is not null")
    return f.select("path", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("bigint").alias("size"), F.lit(float(version)).alias("last_modified"), F.when(F.octet_length("content") % 2 == 0, "tracked").otherwise("staged").alias("status"))


_MANIFEST = "SELECT path, sha256(content) AS file_hash, strlen(content) AS size, CAST({v} AS DOUBLE) AS last_modified, CASE WHEN strlen(content) % 2 = 0 THEN 'tracked' ELSE 'staged' END AS status FROM f{v} WHERE content IS NOT NULL"


@query(f"SELECT path, file_hash, size FROM ({_MANIFEST.format(v=1)}) WHERE status = 'tracked'")
def list_files(spark: SparkSession, d: str) -> DataFrame:
    return metadata.list_files(_manifest(spark, d), "tracked").select("path", "file_hash", "size")


@query(f"SELECT path, file_hash, size FROM ({_MANIFEST.format(v=1)}) WHERE path = (SELECT min(path) FROM f1 WHERE content IS NOT NULL)")
def get_file(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return metadata.by_key(m, "path", m.agg(F.min("path")).first()[0]).select("path", "file_hash", "size")


@query("SELECT commit_hash, message, author, event_id FROM commits WHERE commit_hash = sha256('11')")
def get_commit(spark: SparkSession, d: str) -> DataFrame:
    name = spark.range(1).select(F.sha2(F.lit("11"), 256)).first()[0]
    return metadata.by_key(commits(spark, d), "commit_hash", name).select("commit_hash", "message", "author", "event_id")


@query("SELECT commit_hash, event_id FROM commits ORDER BY micros DESC, commit_hash DESC LIMIT 1")
def latest_commit(spark: SparkSession, d: str) -> DataFrame:
    return metadata.latest_commit(commits(spark, d).withColumn("timestamp", F.col("micros"))).select("commit_hash", "event_id")


@query("SELECT commit_hash, message, author, micros FROM commits ORDER BY micros DESC, commit_hash DESC LIMIT 50")
def commit_log_topk(spark: SparkSession, d: str) -> DataFrame:
    return metadata.list_commits(commits(spark, d).withColumn("timestamp", F.col("micros")), 50).select("commit_hash", "message", "author", "micros")


@query("SELECT count(DISTINCT chunk_hash) AS chunks, (SELECT count(*) FROM commits) AS commits FROM refs")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).agg(F.countDistinct("chunk_hash").alias("chunks")).crossJoin(commits(spark, d).agg(F.count("*").alias("commits")))  # one row each


@query("SELECT * FROM refs WHERE commit_hash = 'v2'")
def commit_chunk_refs(spark: SparkSession, d: str) -> DataFrame:
    return metadata.commit_chunk_refs(refs(spark, d), "v2")


@query("SELECT file_path, chunk_order, refs.chunk_hash, size_uncompressed FROM refs LEFT JOIN (SELECT chunk_hash, max(chunk_length) AS size_uncompressed FROM c1 GROUP BY 1) k ON refs.chunk_hash = k.chunk_hash WHERE commit_hash = 'v2'")
def file_chunks_left_join(spark: SparkSession, d: str) -> DataFrame:
    known = chunks(spark, d, 1).groupBy("chunk_hash").agg(F.max("chunk_length").alias("size_uncompressed")).withColumn("size_compressed", F.lit(0))
    return metadata.file_chunks(refs(spark, d), known, "v2").select("file_path", "chunk_order", "chunk_hash", "size_uncompressed")


@query("SELECT DISTINCT file_path FROM refs WHERE commit_hash = 'v2'")
def commit_file_paths(spark: SparkSession, d: str) -> DataFrame:
    return metadata.commit_file_paths(refs(spark, d), "v2")


@query("SELECT 'v1' AS commit_hash, chunk_hash, min(s) AS first_seq FROM (SELECT chunk_hash, row_number() OVER (ORDER BY path, chunk_order) AS s FROM c1) GROUP BY chunk_hash")
def commit_chunk_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return metadata.commit_chunk_hashes(metadata.numbered_refs(chunks(spark, d), "v1"))


@query("SELECT * FROM edges")
def commit_parents_fallback(spark: SparkSession, d: str) -> DataFrame:
    return metadata.commit_parents(commits(spark, d), parents(spark, d))


@query("SELECT substr(ref_name, 12) AS name, commit_hash FROM branches")
def branch_list(spark: SparkSession, d: str) -> DataFrame:
    return metadata.list_branches(branches(spark, d))


@query("SELECT * FROM branches WHERE starts_with(ref_name, 'refs/heads/user1')")
def ref_prefix(spark: SparkSession, d: str) -> DataFrame:
    return metadata.list_refs(branches(spark, d), "refs/heads/user1")


@query("SELECT DISTINCT chunk_hash FROM refs")
def active_chunks(spark: SparkSession, d: str) -> DataFrame:
    return metadata.active_chunks(refs(spark, d))


@query("SELECT DISTINCT chunk_hash FROM c1 WHERE chunk_hash NOT IN (SELECT chunk_hash FROM c2)")
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return metadata.orphan_chunks(_hashes(spark, d, 1).distinct(), refs(spark, d).where("commit_hash = 'v2'"))


@query("SELECT f2.path, sha256(f2.content) AS file_hash, h.n AS cached_chunks FROM f2 LEFT JOIN (SELECT sha256(content) AS h, max(n) AS n FROM f1 JOIN (SELECT path, count(*) AS n FROM c1 GROUP BY path) USING (path) WHERE content <> '' GROUP BY 1) h ON h.h = sha256(f2.content) WHERE f2.content IS NOT NULL")
def boundary_cache_hit(spark: SparkSession, d: str) -> DataFrame:
    lists = chunks(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_hash"))).alias("chunks"))
    cache = lists.join(_manifest(spark, d).select("path", "file_hash"), "path").groupBy("file_hash").agg(F.max("chunks").alias("chunks"))
    hit = metadata.cached_chunks(_manifest(spark, d, 2), cache)
    return hit.select("path", "file_hash", F.when(F.col("cached").isNotNull(), F.size("cached")).cast("bigint").alias("cached_chunks"))


# ---- metadata writes


@query(f"SELECT * FROM ({_MANIFEST.format(v=2)}) UNION ALL SELECT * FROM ({_MANIFEST.format(v=1)}) WHERE path NOT IN (SELECT path FROM f2)")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    return metadata.upsert(_manifest(spark, d, 1), _manifest(spark, d, 2), ["path"])


@query(f"SELECT path, arg_max(file_hash, last_modified) AS file_hash, max(last_modified) AS last_modified FROM (SELECT * FROM ({_MANIFEST.format(v=2)}) UNION ALL SELECT * FROM ({_MANIFEST.format(v=1)})) GROUP BY path")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    both = _manifest(spark, d, 1).unionAll(_manifest(spark, d, 2))
    return metadata.latest_wins(both.select("path", "file_hash", "last_modified"), ["path"], "last_modified")


@query("SELECT chunk_hash, chunk_length AS size_uncompressed FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY s) AS r FROM (SELECT chunk_hash, chunk_length, 1 AS s FROM c1 UNION ALL SELECT chunk_hash, chunk_length, 2 FROM c2)) WHERE r = 1")
def insert_or_ignore_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda v: chunks(spark, d, v).select("chunk_hash", F.col("chunk_length").alias("size_uncompressed"), (F.col("chunk_order") * 0 + v).alias("seq"))
    empty = rows(1).limit(0)
    first = metadata.insert_or_ignore(empty, rows(1), ["chunk_hash"], "seq")
    return metadata.insert_or_ignore(first, rows(2), ["chunk_hash"], "seq").drop("seq")


@query(f"SELECT path FROM ({_MANIFEST.format(v=1)}) WHERE path NOT IN (SELECT path FROM f2)")
def remove_files(spark: SparkSession, d: str) -> DataFrame:
    return metadata.delete(_manifest(spark, d, 1), files(spark, d, 2), ["path"]).select("path")


@query("""SELECT 'commit' AS kind, commit_hash, '' AS other FROM commits WHERE event_id % 5 <> 0
    UNION ALL SELECT 'parent', commit_hash, parent_hash FROM parents WHERE commit_hash NOT IN (SELECT commit_hash FROM commits WHERE event_id % 5 = 0)
    UNION ALL SELECT 'reference', commit_hash, sha256(message) FROM commits WHERE event_id % 5 <> 0""")
def delete_commit_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth commit is deleted; each commit references one chunk, named after its message."""
    c = commits(spark, d)
    held = c.select("commit_hash", F.sha2("message", 256).alias("chunk_hash"))
    kept, refs_kept, parents_kept = metadata.delete_commits(c, held, parents(spark, d), c.where("event_id % 5 = 0"))
    rows = kept.select(F.lit("commit").alias("kind"), "commit_hash", F.lit("").alias("other"))
    return rows.unionAll(parents_kept.select(F.lit("parent"), "commit_hash", "parent_hash")).unionAll(refs_kept.select(F.lit("reference"), "commit_hash", "chunk_hash"))


@query("SELECT DISTINCT chunk_hash FROM c1 WHERE chunk_hash IN (SELECT chunk_hash FROM c2)")
def delete_orphan_records(spark: SparkSession, d: str) -> DataFrame:
    live = refs(spark, d).where("commit_hash = 'v2'")
    known = _hashes(spark, d, 1).distinct()
    return metadata.delete_chunk_records(known, live, known)


@query("SELECT * FROM (VALUES ('chunker_avg_size', '1048576', '2097152'), ('chunker_id', 'other', 'chunkwell-gear-sha256-v1')) t(\"key\", recorded, expected)")
def format_signature_diff(spark: SparkSession, d: str) -> DataFrame:
    recorded = spark.createDataFrame([("chunker_id", "other"), ("chunker_min_size", "524288"), ("chunker_avg_size", "1048576"), ("created", "x")], "key string, value string")
    return metadata.signature_differences(recorded)


# ---- commit graph


_REACH = "reach AS (SELECT commit_hash AS start, commit_hash FROM branches UNION SELECT start, parent_hash FROM reach JOIN edges USING (commit_hash))"


@query(f", {_REACH} SELECT start, commit_hash, coalesce(micros, 0) / 1 AS timestamp FROM reach LEFT JOIN commits USING (commit_hash)", recursive=True)
def commit_history(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d)
    return dag.commit_history(c.withColumn("timestamp", F.col("micros").cast("double")), branches(spark, d), metadata.commit_parents(c, parents(spark, d)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every commit against the head of its author's branch and of another one's."""
    b = branches(spark, d).select(F.substring("ref_name", 12, 100).alias("author"), F.col("commit_hash").alias("descendant"))
    return commits(spark, d).select(F.col("commit_hash").alias("ancestor"), F.explode(F.array("author", F.concat("author", F.lit("1")))).alias("author")).join(b, "author").select("ancestor", "descendant").distinct()


@query(f", {_REACH}, pairs AS (SELECT DISTINCT c.commit_hash AS ancestor, b.commit_hash AS descendant FROM (SELECT commit_hash, author FROM commits UNION ALL SELECT commit_hash, author || '1' FROM commits) c JOIN branches b ON substr(b.ref_name, 12) = c.author) SELECT ancestor, descendant, r.start IS NOT NULL AS is_ancestor FROM pairs LEFT JOIN (SELECT DISTINCT start, commit_hash FROM reach) r ON r.start = descendant AND r.commit_hash = ancestor", recursive=True)
def is_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return dag.is_ancestor(_pairs(spark, d), metadata.commit_parents(commits(spark, d), parents(spark, d)))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = commits(spark, d).withColumn("timestamp", F.col("micros"))
    return c, c.where("event_id < 700 or event_id % 3 = 0")


@query("SELECT commit_hash, event_id FROM commits WHERE NOT (event_id < 700 OR event_id % 3 = 0)")
def missing_commits(spark: SparkSession, d: str) -> DataFrame:
    return dag.missing_commits(*_sides(spark, d)).select("commit_hash", "event_id")


@query("SELECT commit_hash, event_id FROM commits WHERE event_id < 700 OR event_id % 3 = 0 ORDER BY micros DESC, commit_hash DESC LIMIT 1")
def newest_common_commit(spark: SparkSession, d: str) -> DataFrame:
    return dag.newest_common_commit(*_sides(spark, d)).select("commit_hash", "event_id")


@query("""
, wanted AS (SELECT left(commit_hash, CAST(1 + event_id % 15 AS INT)) AS ref FROM commits UNION SELECT ref_name FROM branches UNION SELECT substr(ref_name, 12) FROM branches UNION SELECT commit_hash FROM commits),
found AS (
    SELECT ref, b.commit_hash, 1 AS kind FROM wanted JOIN branches b ON ref = substr(b.ref_name, 12)
    UNION SELECT ref, b.commit_hash, 2 FROM wanted JOIN branches b ON ref = b.ref_name
    UNION SELECT ref, c.commit_hash, 3 FROM wanted JOIN commits c ON ref = c.commit_hash
    UNION SELECT ref, c.commit_hash, 4 FROM wanted JOIN commits c ON starts_with(c.commit_hash, ref)),
n AS (SELECT ref, kind, count(*) AS n, min(commit_hash) AS h FROM found GROUP BY 1, 2),
m AS (SELECT ref, arg_min(n, kind) AS n, arg_min(h, kind) AS h FROM n GROUP BY 1)
SELECT ref, CASE WHEN n = 1 THEN h END AS commit_hash, coalesce(n, 0) AS n FROM wanted LEFT JOIN m USING (ref)""")
def resolve_ref(spark: SparkSession, d: str) -> DataFrame:
    """Every full hash and branch, and prefixes from one digit up."""
    c, b = commits(spark, d), branches(spark, d)
    short = c.select(F.substring(F.col("commit_hash"), F.lit(1), (1 + F.col("event_id") % 15).cast("int")).alias("ref"))
    return dag.resolve(short.union(b.select("ref_name")).union(b.select(F.substring("ref_name", 12, 100))).union(c.select("commit_hash")).distinct(), b, c, least=1)


# ---- integrity


_STATUS = "SELECT k.h AS chunk_hash, CASE WHEN data IS NULL THEN 'missing' WHEN sha256(data) <> k.h THEN 'corrupt' ELSE 'ok' END AS status FROM (SELECT DISTINCT sha256(content) AS h FROM f1 WHERE content IS NOT NULL) k LEFT JOIN stored ON stored.chunk_hash = k.h"


@query(_STATUS)
def verify_payload(spark: SparkSession, d: str) -> DataFrame:
    """Through zstd: damaged bytes are compressed, stored, read and compared."""
    chunking.ship(spark)
    objects = stored(spark, d).select("chunk_hash", compress(F.col("data").cast("binary")).alias("payload"))
    return integrity.scan(_manifest(spark, d).select(F.col("file_hash").alias("chunk_hash")), objects)


@query(f"SELECT count(*) AS referenced, (SELECT count(*) FROM stored) AS stored, count_if(status = 'missing') AS missing, count_if(status = 'corrupt') AS corrupt, CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS unrecorded FROM ({_STATUS})")
def fsck_status(spark: SparkSession, d: str) -> DataFrame:
    active = _manifest(spark, d).select(F.col("file_hash").alias("chunk_hash")).distinct()
    s = stored(spark, d).withColumn("data", F.col("data").cast("binary"))
    return integrity.fsck(active, active, s, integrity.scan_raw(active, s))


@query("SELECT count(*) AS deleted, CAST(coalesce(sum(strlen(data)), 0) AS BIGINT) AS freed_bytes FROM stored WHERE chunk_hash NOT IN (SELECT sha256(content) FROM f2 WHERE content IS NOT NULL)")
def gc_plan(spark: SparkSession, d: str) -> DataFrame:
    s = stored(spark, d).withColumn("payload", F.col("data").cast("binary"))
    return store.collect_garbage(s, _manifest(spark, d, 2).select(F.col("file_hash").alias("chunk_hash")))[1]


def _restored(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.line_chunks(files(spark, d))
    data = rows.select("chunk_hash", "data").dropDuplicates(["chunk_hash"])
    return integrity.restore(rows.select(F.col("path").alias("file_path"), "chunk_hash", "chunk_length", "chunk_order"), data)


@query("SELECT path, sha256(content) AS file_hash FROM f1 WHERE content IS NOT NULL AND content <> ''")
def restore_text(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("path", F.sha2("content", 256).alias("file_hash"))


@query("SELECT path, true AS size_ok, strlen(content) AS size FROM f1 WHERE content IS NOT NULL AND content <> ''")
def restore_size_check(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("path", "size_ok", F.octet_length("content").cast("bigint").alias("size"))


# ---- merge and sync


def _sides_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = refs(spark, d)
    return r.where("commit_hash = 'v1'"), r.where("commit_hash = 'v2'")


_MERGE = "SELECT coalesce(a.path, b.path) AS file_path, CASE WHEN b.path IS NULL THEN 'ours' WHEN a.path IS NULL THEN 'theirs' WHEN a.content = b.content THEN 'both' ELSE 'conflict' END AS side FROM (SELECT * FROM f1 WHERE content IS NOT NULL AND content <> '') a FULL JOIN (SELECT * FROM f2 WHERE content IS NOT NULL AND content <> '') b ON a.path = b.path"


@query(_MERGE)
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_paths(*_sides_refs(spark, d)).select("file_path", "side")


@query(f"SELECT file_path FROM ({_MERGE}) WHERE side = 'conflict'")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merge.conflicts(*_sides_refs(spark, d))


@query(f"SELECT file_path, chunk_order, chunk_hash, chunk_offset, chunk_length FROM refs WHERE commit_hash = 'v1' AND file_path IN (SELECT file_path FROM ({_MERGE}) WHERE side IN ('ours', 'both'))")
def merge_offsets(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged_refs(*_sides_refs(spark, d))


def _sync(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Source commits, target commits, candidates and the objects of both sides (source less a tenth, target v1's of two prefixes)."""
    source = spark.createDataFrame([("v1", 1.0), ("v2", 2.0)], "commit_hash string, timestamp double")
    wanted = sync.candidates(source, refs(spark, d), source.where("commit_hash = 'v1'"))
    held = chunks(spark, d, 2).groupBy("chunk_hash").agg(F.max("chunk_length").alias("stored_bytes"))
    return source, wanted, held.where("chunk_hash not like '0%'"), held.where("chunk_hash like '1%' or chunk_hash like '2%'")


_PLAN = "SELECT chunk_hash, CASE WHEN chunk_hash LIKE '1%' OR chunk_hash LIKE '2%' THEN 'skip' WHEN chunk_hash LIKE '0%' THEN 'absent' ELSE 'send' END AS action, max(chunk_length) AS l FROM c2 WHERE chunk_hash NOT IN (SELECT chunk_hash FROM c1) GROUP BY 1"


@query(f"SELECT chunk_hash, action FROM ({_PLAN})")
def push_plan(spark: SparkSession, d: str) -> DataFrame:
    _, wanted, source, target = _sync(spark, d)
    return sync.plan(wanted, source, target)


@query(f"SELECT count_if(action = 'send') AS transferred_chunks, CAST(coalesce(sum(l) FILTER (action = 'send'), 0) AS BIGINT) AS transferred_bytes, count_if(action = 'skip') AS skipped_chunks, CAST(1 AS BIGINT) AS commits_synced, true AS used_merkle_delta FROM ({_PLAN})")
def push_stats(spark: SparkSession, d: str) -> DataFrame:
    commit_rows, wanted, source, target = _sync(spark, d)
    return sync.stats(sync.plan(wanted, source, target), source, dag.missing_commits(commit_rows, commit_rows.where("commit_hash = 'v1'")), True)


@query(f"SELECT chunk_hash FROM ({_PLAN}) WHERE action = 'send'")
def pull_plan(spark: SparkSession, d: str) -> DataFrame:
    _, wanted, source, target = _sync(spark, d)
    return sync.transfer(wanted, source, target).select("chunk_hash")


# ---- scalars


@query("SELECT path, NOT (path LIKE '%/1%') AS safe FROM f1")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of which those with a part that begins with 1 were turned into ones that leave the root."""
    p = files(spark, d).select("path", F.when(F.col("path").contains("/1"), F.concat(F.lit("a/../../"), "path")).otherwise(F.col("path")).alias("p"))
    return p.select("path", scalars.is_safe_path(F.col("p")).alias("safe"))


@query("SELECT path FROM f1 WHERE NOT starts_with(path, 'doc/fr/')")
def rm_prefix(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(~F.col("path").startswith("doc/fr/")).select("path")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' bytes' END AS text FROM (SELECT *, CAST(l_orderkey * l_linenumber * 997 AS BIGINT) AS b FROM lineitem)")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.format_bytes(F.col("l_orderkey") * F.col("l_linenumber") * 997).alias("text"))


@query("SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm%02ds (%.1fs)', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60, s) END AS text FROM (SELECT event_id, event_id % 5000 + 0.25 AS s FROM events)")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.format_duration((F.col("event_id") % 5000 + 0.25).cast("double")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN r <= 0 THEN '-' WHEN r >= 1048576 THEN printf('%.1f MB/s', r / 1048576.0) WHEN r >= 1024 THEN printf('%.1f KB/s', r / 1024.0) ELSE printf('%.0f B/s', r) END AS text FROM (SELECT *, CAST(l_orderkey * 997 AS BIGINT) / (l_linenumber / 8.0) AS r FROM lineitem)")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.throughput(F.col("l_orderkey") * 997, F.col("l_linenumber") / 8.0).alias("text"))


@query("SELECT commit_hash, strftime(make_timestamp(micros), '%Y-%m-%d %H:%M:%S') AS at, left(commit_hash, 12) AS short, left(message, 50) AS subject FROM commits")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d)
    return c.select("commit_hash", scalars.format_time(F.floor(F.col("micros") / 1000000)).alias("at"), scalars.short_hash(F.col("commit_hash")).alias("short"), scalars.subject(F.col("message")).alias("subject"))


@query("SELECT event_id, sha256(commit_hash || ':' || message || ':' || micros || ':' || coalesce(parent_hash, '')) AS id FROM commits")
def commit_hash(spark: SparkSession, d: str) -> DataFrame:
    return commits(spark, d).select("event_id", scalars.commit_hash(F.col("commit_hash"), F.col("message"), F.col("micros").cast("string"), F.col("parent_hash")).alias("id"))


@query("SELECT ref_name, substr(ref_name, 12) AS short, ref_name AS full_name, regexp_full_match(substr(ref_name, 12), '[A-Za-z0-9._/-]{1,255}') AS valid FROM branches")
def branch_names(spark: SparkSession, d: str) -> DataFrame:
    short = scalars.short_branch_name(F.col("ref_name"))
    return branches(spark, d).select("ref_name", short.alias("short"), scalars.branch_ref_name(short).alias("full_name"), scalars.is_reference(short).alias("valid"))
