"""Explicit schemas of the nine metadata tables and of chunk and object rows; nothing is inferred."""

from pyspark.sql.types import StructType

FILES = "path string, file_hash string, size bigint, last_modified double, status string, updated_at timestamp"
COMMITS = "commit_hash string, parent_hash string, message string, author string, timestamp double, merkle_root_hash string"
CHUNKS = "chunk_hash string, size_uncompressed bigint, size_compressed bigint, created_at timestamp"
CHUNK_REFS = "ref_seq bigint, commit_hash string, file_path string, chunk_hash string, chunk_offset bigint, chunk_length bigint, chunk_order int"
REFS = "ref_name string, commit_hash string, updated_at timestamp"
CONFIG = "key string, value string"
COMMIT_PARENTS = "commit_hash string, parent_hash string, ordinal int"
REPO_META = "key string, value string"
CHUNK_CACHE = "file_hash string, chunks array<struct<hash:string, offset:bigint, length:bigint>>, file_size bigint, chunk_count int"
OBJECTS = "prefix string, chunk_hash string, raw_bytes bigint, stored_bytes bigint, payload binary"
MERKLE_NODES = "commit_hash string, node_path string, level int, hash string, is_leaf boolean, leaf_pos bigint"

TABLES = {
    "files": FILES, "commits": COMMITS, "chunks": CHUNKS, "chunk_refs": CHUNK_REFS, "refs": REFS, "config": CONFIG,
    "commit_parents": COMMIT_PARENTS, "repo_meta": REPO_META, "chunk_cache": CHUNK_CACHE,
    "objects": OBJECTS, "merkle_nodes": MERKLE_NODES,
}
#: Primary keys, by which upserts replace rows.
KEYS = {"files": ["path"], "commits": ["commit_hash"], "chunks": ["chunk_hash"], "refs": ["ref_name"], "config": ["key"], "repo_meta": ["key"], "chunk_cache": ["file_hash"], "objects": ["chunk_hash"], "commit_parents": ["commit_hash", "ordinal"]}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
