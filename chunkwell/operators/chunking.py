"""Files to chunk rows: content-defined by an Arrow-batched scan, or by lines in column functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import with_prefix_sums
from ..functions.codec import compress
from ..functions.scalars import AVG_SIZE, MAX_SIZE, MIN_SIZE, human_size
from ..sources.session import ship

SMALL = (64, 256, 1024)
#: Bytes of chunks in an Arrow batch, about.
BATCH = 32 << 20


def read_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """path, content of the files under a folder; without content the bytes aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "content") if content else df.select("path", F.col("length"), "modificationTime")


def file_info(files: DataFrame) -> DataFrame:
    """path, name, size and size_text of files (path, length)."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), human_size(F.col("length")).alias("size_text"))


def places(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """path, place of files that executors open by themselves, of any size; paths: from path to place."""
    return spark.createDataFrame(sorted(paths.items()), "path string, place string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a file of one row group is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _source(files: DataFrame) -> DataFrame:
    """path and the whole content, or the place where it is."""
    if "place" in files.columns:
        return files.select("path", F.col("place").alias("content"))
    return spread(files.select("path", F.col("content").cast("binary").alias("content")))


def _opened(batches: Iterator, placed: bool) -> Iterator[tuple]:
    """(path, content) of each file that is there: a buffer, or a file mapped into memory."""
    import mmap

    for b in batches:
        for path, c in zip(b.column(0).to_pylist(), b.column(1)):
            if not placed:
                if c.is_valid:
                    yield path, c.as_buffer().to_pybytes()
                continue
            try:
                with open(c.as_py(), "rb") as f:
                    yield path, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""
            except FileNotFoundError:
                continue


def file_states(files: DataFrame) -> DataFrame:
    """path, file_hash and size of each of files (path, content or place) that is there."""
    if "place" not in files.columns:
        return files.where("content is not null").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"), F.octet_length("content").cast("bigint").alias("size"))
    ship(files.sparkSession)

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for path, c in _opened(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([hashlib.sha256(c).hexdigest()]), pa.array([len(c)], pa.int64())], ["path", "file_hash", "size"])

    return _source(files).mapInArrow(read, "path string, file_hash string, size bigint")


def boundaries(files: DataFrame, sizes: tuple[int, int, int] = (MIN_SIZE, AVG_SIZE, MAX_SIZE)) -> DataFrame:
    """path, chunk_order, chunk_offset, chunk_length of files (path, content binary); empty and null files have no chunks.

    Files no longer than the smallest size are one chunk and skip Python.
    """
    ship(files.sparkSession)
    small, names = F.octet_length("content") <= sizes[0], ["path", "chunk_order", "chunk_offset", "chunk_length"]
    rows = files.select("path", F.col("content").cast("binary").alias("content"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from chunkwell.functions.cdc import cuts

        for b in batches:
            out = [(p, k, o, n) for p, c in _opened([b], False) for k, (o, n) in enumerate(cuts(c, *sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names)

    large = spread(rows.where(~small)).mapInArrow(cut, "path string, chunk_order int, chunk_offset bigint, chunk_length bigint")
    one = rows.where(small & (F.octet_length("content") > 0)).select("path", F.lit(0).alias("chunk_order"), F.lit(0).cast("bigint").alias("chunk_offset"), F.octet_length("content").cast("bigint").alias("chunk_length"))
    return large.unionAll(one)


def chunk_files(files: DataFrame, sizes: tuple[int, int, int] = (MIN_SIZE, AVG_SIZE, MAX_SIZE), data: bool = False, empty: bool = False) -> DataFrame:
    """boundaries() with chunk_hash, and the chunk's data if asked for; hashed where the file is read.

    files: (path, content), or (path, place) of files of any size, which are opened where they are and held in memory
    by no row. empty: an empty file has one chunk of length 0, and not none.
    """
    ship(files.sparkSession)
    placed = "place" in files.columns

    def cut(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from chunkwell.functions.cdc import cuts

        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if data else [])]
        names = ["path", "chunk_order", "chunk_offset", "chunk_length", "chunk_hash", *(["data"] if data else [])]
        held, size = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)

        for path, raw in _opened(batches, placed):
            for k, (o, n) in enumerate(cuts(raw, *sizes) or [(0, 0)] * empty):
                part = raw[o : o + n]
                held.append((path, k, o, n, hashlib.sha256(part).hexdigest(), *([part] if data else [])))
                size += 200 + n * data
                if size >= BATCH:  # chunks may be megabytes
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    return _source(files).mapInArrow(cut, "path string, chunk_order int, chunk_offset bigint, chunk_length bigint, chunk_hash string" + (", data binary" if data else ""))


def pieces(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_hash, data of wanted (path, chunk_hash, chunk_offset, chunk_length) ranges of files (path, content or place).

    Files with a place are read by the executors at the ranges alone: only their names are shuffled. Content is
    joined to its ranges by path, and files without any are left out before.
    """
    ship(files.sparkSession)
    if "place" not in files.columns:
        ranges = wanted.groupBy("path").agg(F.collect_list(F.struct("chunk_hash", "chunk_offset", "chunk_length")).alias("r"))
        each = files.select("path", F.col("content").cast("binary").alias("content")).join(ranges, "path").select("content", F.explode("r").alias("r"))
        return each.select("r.chunk_hash", F.substring(F.col("content"), F.col("r.chunk_offset").cast("int") + 1, F.col("r.chunk_length").cast("int")).alias("data"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for b in batches:
            for place, name, at, n in zip(*(c.to_pylist() for c in b.columns)):
                with open(place, "rb") as f:
                    f.seek(at)
                    held.append((name, f.read(n)))
                size += n
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["chunk_hash", "data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["chunk_hash", "data"])

    ranges = files.select("path", "place").join(wanted, "path").select("place", "chunk_hash", "chunk_offset", "chunk_length")
    return ranges.repartition("place", "chunk_offset").mapInArrow(read, "chunk_hash string, data binary")


def line_chunks(files: DataFrame) -> DataFrame:
    """Chunk rows cut after every newline, in column functions only: path, chunk_order, chunk_offset, chunk_length, chunk_hash, data."""
    content = F.col("content").cast("string")
    parts = F.split(content, "\n", -1)
    rows = files.where(F.octet_length("content") > 0).select("path", parts.alias("parts"))
    rows = rows.select("path", F.filter(F.transform("parts", lambda p, i: F.when(i < F.size("parts") - 1, F.concat(p, F.lit("\n"))).otherwise(p)), lambda p: p != "").alias("parts"))
    rows = with_prefix_sums(rows.withColumn("lengths", F.transform("parts", lambda p: F.octet_length(p).cast("bigint"))), "lengths", "offsets")
    each = rows.select("path", F.posexplode(F.arrays_zip("parts", "lengths", "offsets")).alias("chunk_order", "c"))
    return each.select("path", "chunk_order", F.col("c.offsets").alias("chunk_offset"), F.col("c.lengths").alias("chunk_length"), F.sha2("c.parts", 256).alias("chunk_hash"), F.col("c.parts").cast("binary").alias("data"))


def read_chunk_at(files: DataFrame, offset: int, length: int) -> DataFrame:
    """path and the bytes of a range of each file."""
    return files.select("path", F.substring(F.col("content").cast("binary"), offset + 1, length).alias("data"))


def process_chunks(chunks: DataFrame, known: DataFrame | None = None, level: int = 3) -> DataFrame:
    """chunks (with data) plus payload: zstd of chunks whose hash isn't in known, null for the others.

    The anti join comes first, so only missing chunks reach the codec.
    """
    if known is None:
        return chunks.withColumn("payload", compress(F.col("data"), level))
    marked = chunks.join(known.select("chunk_hash").distinct().withColumn("_known", F.lit(True)), "chunk_hash", "left")
    new = marked.where("_known is null").drop("_known")
    return new.withColumn("payload", compress(F.col("data"), level)).unionByName(marked.where("_known").drop("_known").withColumn("payload", F.lit(None).cast("binary")))


def new_or_reused(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunks with is_new: the first of its hash, by path and order, and not in known.

    The first places are found by a minimum a hash, combined before the shuffle: a hash may fill a third of all rows.
    """
    first = chunks.groupBy("chunk_hash").agg(F.min(F.struct("path", "chunk_order")).alias("f"))
    fresh = first.join(known.select("chunk_hash").distinct(), "chunk_hash", "left_anti").select(F.col("f.path").alias("path"), F.col("f.chunk_order").alias("chunk_order"), F.lit(True).alias("is_new"))
    return chunks.join(fresh, ["path", "chunk_order"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def dedup_summary(chunks: DataFrame, *by: str) -> DataFrame:
    """Of each group: files, chunks, unique chunks and bytes, and the share that needn't be stored again."""
    per = chunks.groupBy(*by, "chunk_hash").agg(F.count("*").alias("n"), F.max("chunk_length").alias("length"))
    sums = per.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("raw_bytes"), F.sum("length").alias("unique_bytes"))
    files = chunks.where("chunk_order = 0").groupBy(*by).agg(F.count("*").alias("files"))
    joined = sums.join(files, list(by)) if by else sums.crossJoin(files)
    return joined.select(*by, "files", "chunks", "unique_chunks", "raw_bytes", "unique_bytes", F.round(100.0 * (F.col("chunks") - F.col("unique_chunks")) / F.col("chunks"), 4).alias("dedup_percent"))


def contiguity(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, bytes, and whether they begin at 0 and follow one another without gaps."""
    before = F.lag(F.col("chunk_offset") + F.col("chunk_length")).over(Window.partitionBy("path").orderBy("chunk_order"))
    rows = chunks.select("path", "chunk_length", (F.col("chunk_offset") == F.coalesce(before, F.lit(0))).alias("follows"))
    return rows.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("chunk_length").alias("bytes"), F.bool_and("follows").alias("contiguous"))


def cdc_udtf(spark: SparkSession, name: str = "cdc", sizes: tuple[int, int, int] = SMALL) -> None:
    """Register a table function cdc(content) -> chunk_order, chunk_offset, chunk_length, chunk_hash for SQL."""
    ship(spark)

    class Cut:
        def eval(self, content: bytes):
            import hashlib

            from chunkwell.functions.cdc import cuts

            for k, (o, n) in enumerate(cuts(bytes(content or b""), *sizes)):
                yield k, o, n, hashlib.sha256(content[o : o + n]).hexdigest()

    spark.udtf.register(name, F.udtf(Cut, returnType="chunk_order int, chunk_offset bigint, chunk_length bigint, chunk_hash string"))
