"""Benchmark decontamination by a prefix-filtered set join.

A window (13 consecutive words of a benchmark item, or the whole of a shorter one) is a sequence of shingles. For a
document to contain the window it must contain each of them, so one is a sufficient prefix: the rarest in the whole
corpus, which joins with fewest places. A first pass counts the benchmark's shingles over all documents; windows with
a shingle that occurs nowhere are done. A second finds the prefix shingles' places; the shingle's place in its window
bounds the position, the window's length bounds the end, and what is left is compared word by word.

The benchmark's words are broadcast while there are at most MAX_WORDS of them (a checked size); beyond that the same
join runs as DataFrame operations, shuffled by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IDS, free, mark, materialise, prepare, release, slices, small, with_rows, words_of

WINDOW, SHINGLE = 13, 3
#: Words of a benchmark that is broadcast: some 100 MB in a Python worker.
MAX_WORDS = 250_000
#: A document is contaminated if one in so many of its words is hit.
PART = 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """All windows of the benchmark as ids of words, with their shingles as sorted codes."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        import numpy as np

        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        v = len(self.vocabulary)
        if v >= 2_000_000:
            raise ValueError("a shingle's code must fit 63 bits")
        self.base = v + 1
        places = [(item, [self.vocabulary[w] for w in ws]) for item, ws in items if ws]
        known: dict[tuple[int, ...], set[int]] = {}
        for item, ids in places:
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                known.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.windows = sorted(known)
        self.items = [sorted(known[w]) for w in self.windows]
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.shingles(np.array(w, np.int64)) for w in self.windows)]))
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})

    def shingles(self, ids, size: int | None = None):
        """The code of each shingle of a sequence of word ids; -1 where a word is unknown."""
        import numpy as np

        size = min(SHINGLE, len(ids)) if size is None else size
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, good = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            part = ids[j : j + n]
            code = code * self.base + part + 1
            good &= part >= 0
        code[~good] = -1
        return code

    def found(self, codes, among):
        """Places of codes that are in a sorted array, and where there."""
        import numpy as np

        if not len(among) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
        hit = np.flatnonzero(among[at] == codes)
        return hit, at[hit]

    def choose(self, counts) -> None:
        """The rarest shingle of each window becomes its prefix; windows with one that doesn't occur are left out."""
        import numpy as np

        by: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.windows):
            codes = self.shingles(np.array(w, np.int64))
            n = counts[np.searchsorted(self.codes, codes)]
            at = int(np.argmin(n))
            if n[at]:
                by.setdefault(int(codes[at]), []).append((k, at))
        self.prefixes = np.array(sorted(by), np.int64)
        each = [by[int(c)] for c in self.prefixes]
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
        self.window = np.array([k for e in each for k, _ in e], np.int64)
        self.offset = np.array([o for e in each for _, o in e], np.int64)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.flat = np.array([i for w in self.windows for i in w], np.int64)

    def match(self, ids):
        """(start, window) of every occurrence in a sequence of word ids."""
        import numpy as np

        places, keys = [], []
        for size in self.sizes:
            hit, key = self.found(self.shingles(ids, size), self.prefixes)
            places.append(hit)
            keys.append(key)
        hit, key = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *keys])
        n = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        window = self.window[entry]
        start = np.repeat(hit, n) - self.offset[entry]
        fits = (start >= 0) & (start + self.length[window] <= len(ids))
        start, window = start[fits], window[fits]
        for j in range(int(self.length.max(initial=0))):  # word by word, with those that still agree
            inside = j < self.length[window]
            same = ~inside
            same[inside] = ids[start[inside] + j] == self.flat[self.start[window[inside]] + j]
            start, window = start[same], window[same]
        both = np.unique(np.stack([start, window]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def _ids(vocabulary: dict[bytes, int], texts: list[str | None]):
    """Word ids of several texts, a -1 after each, and how many words each has."""
    import numpy as np

    get, flat, n = vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        n.append(len(words))
        flat += [get(w, -1) for w in words]
        flat.append(-1)
    return np.array(flat, np.int64), np.array(n, np.int64)


def judge(index: Windows, texts: list[str | None]):
    """n_words, n_hit and the items of each text."""
    import numpy as np

    ids, n = _ids(index.vocabulary, texts)
    ends = np.cumsum(n + 1)
    start, window = index.match(ids)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.length[window], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    items: list[set[int]] = [set() for _ in texts]
    for doc, w in zip(np.searchsorted(ends, start, side="right").tolist(), window.tolist()):
        items[doc].update(index.items[w])
    return n, inside[ends] - inside[ends - n - 1], items


def _indexed(docs: DataFrame, items: DataFrame, window: int, max_words: int):
    """The benchmark's windows, each with its rarest shingle over all documents as prefix, as a broadcast; None if it is too large."""
    import numpy as np

    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 2 * max_words:  # a word and its separator are two bytes at least
        return None
    spark = docs.sparkSession
    index = Windows([(r.item_id, words_of(r.text)) for r in items.collect()], window)
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        index, total = shared.value, None
        for b in slices(batches, 0):
            ids, _ = _ids(index.vocabulary, b.column(0).to_pylist())
            total = np.zeros(len(index.codes), np.int64) if total is None else total
            for size in index.sizes:
                total += np.bincount(index.found(index.shingles(ids, size), index.codes)[1], minlength=len(total))
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counts = np.zeros(len(index.codes), np.int64)
    if len(counts):
        for r in docs.selectExpr("cast(text as string) text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # a row for each shingle of the benchmark
            counts[r.code] = r.n
    index.choose(counts)
    return spark.sparkContext.broadcast(index)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").selectExpr("cast(item_id as long) item_id", "cast(text as string) text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of documents (doc_id, text) against benchmark (item_id, text); see RESULT.

    n_words: its words; n_hit: those inside an occurrence of a window; n_items: items with occurring windows;
    items_sha256: of their ids, sorted as strings and comma-joined; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null texts have no words; items without words, and rows with a null item_id, have no windows; rows of one item_id
    are one item, windows of each row. Null and repeated doc_ids stay rows; other columns are ignored; either table
    may be empty.
    """
    prepare(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    chosen = _indexed(docs, _items(benchmark), window, max_words)
    if chosen is None:
        return contamination_joined(docs, _items(benchmark), window)

    def join(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in slices(batches, 1):
            n, hits, items = judge(chosen.value, b.column(1).to_pylist())
            digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array((hits > 0) & (PART * hits >= n))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.mapInArrow(join, RESULT)


class _Keys:
    """of(words, size): a 64-bit key of each shingle. Words' hashes are kept, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes], size: int):
        import numpy as np
        import xxhash

        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(0, len(h) - size + 1)
        key, prime = np.full(n, size, np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for j in range(size):
            key = (key ^ h[j : j + n]) * prime
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def _held(table, keys):
    """Which keys a Bloom filter has: one look-up by the lower bits, one by the upper."""
    import numpy as np

    bits, k = len(table) * 64, keys.view(np.uint64)
    there = np.ones(len(k), bool)
    for at in (k % np.uint64(bits), (k >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)):
        there &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return there


def _bloom(keys: DataFrame, most: int = 1 << 27):
    """A Bloom filter of a column key as 64-bit words, 16 bits a key and `most` at most: beyond that it lets more
    through to the join, which decides. What reaches the driver is the filter."""
    import numpy as np

    n = keys.count()
    bits = min(most, 1 << max(16, (16 * max(1, n)).bit_length()))

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words: dict[int, int] = {}
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            for at in (k % np.uint64(bits), (k >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)):
                for w, bit in zip((at >> np.uint64(6)).tolist(), (at & np.uint64(63)).tolist()):
                    words[w] = words.get(w, 0) | 1 << bit
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(np.array(list(words.values()), np.uint64).view(np.int64))], ["w", "b"])

    found = keys.select("key").mapInArrow(fold, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return table


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, window (its words with spaces) and n of every window."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 1):
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                n = min(window, len(w))
                out += [(item, b" ".join(w[i : i + n]).decode("utf-8", "surrogatepass"), n) for i in range(len(w) - n + 1 if w else 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.string(), pa.int32()))], ["item_id", "window", "n"])

    return items.select("item_id", "text").mapInArrow(cut, "item_id long, window string, n int").distinct()


def _parts(windows: DataFrame) -> DataFrame:
    """window, n, size, offset, key of each shingle of windows (window, n); size is its number of words."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys = _Keys()
        for b in batches:
            for window, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = min(SHINGLE, n)
                k = keys.of(window.encode("utf-8", "surrogatepass").split(b" "), size)
                yield pa.RecordBatch.from_arrays([pa.array([window] * len(k), pa.string()), pa.array([n] * len(k), pa.int32()), pa.array([size] * len(k), pa.int32()), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(k)], ["window", "n", "size", "offset", "key"])

    return windows.select("window", "n").mapInArrow(cut, "window string, n int, size int, offset int, key long")


def _joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """row, n_words, n_hit, n_items, items_sha256 of (row, text), for a benchmark of any size: joined by shingle.

    Bloom filters of the benchmark's shingles, and then of the windows' prefixes, keep other shingles in the scan. A
    place of a prefix goes on with the words around it, so a window is compared word by word without its document.
    """
    spark, empty = rows.sparkSession, F.sha2(F.lit(""), 256)
    since = mark(spark)
    held = materialise(_item_windows(items, window), "item-windows")
    windows = held.select("window", "n").distinct()
    parts = materialise(_parts(windows), "parts")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most SHINGLE
    texts = rows.select("row", F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(_bloom(parts.select("key").distinct()))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys = _Keys()
        for b in slices(batches, 1):
            found = [k[_held(shared.value, k)] for t in b.column(1).to_pylist() if (w := words_of(t)) for k in (keys.of(w, size) for size in sizes)]
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["key", "n"])

    rarity = materialise(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("rarity")), "rarity")
    ranked = parts.join(rarity, "key", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "offset", "size", "key")).alias("p"))
    prefixes = materialise(ranked.where("p.rarity > 0").select("window", "n", "p.offset", "p.size", "p.key"), "prefixes")
    second = spark.sparkContext.broadcast(_bloom(prefixes.select("key").distinct()))

    def places(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, names = _Keys(), ["row", "key", "at", "back", "around"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for b in slices(batches, 1):
            out = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                for size in sizes:
                    k = keys.of(w, size)
                    for at in np.flatnonzero(_held(second.value, k)).tolist():
                        low = max(0, at - window + 1)
                        out.append((row, int(k[at]), at, at - low, b" ".join(w[low : at + window]).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)

    near = texts.mapInArrow(places, "row long, key long, at long, back int, around string").join(prefixes, "key").where("back >= offset")
    words = F.slice(F.split("around", " "), F.col("back") - F.col("offset") + 1, F.col("n"))
    sure = near.where(F.array_join(words, " ") == F.col("window")).select("row", (F.col("at") - F.col("offset")).alias("start"), "n", "window")
    sure = materialise(sure.distinct(), "sure")
    n_hit = sure.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    found = sure.select("row", "window").distinct().join(held.select("window", "item_id"), "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    names = found.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    hits = materialise(n_hit.join(names, "row"), "hits")
    release(spark, since, [hits])

    def size(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t)) for t in b.column(1).to_pylist()], pa.int64())], ["row", "n_words"])

    every = texts.mapInArrow(size, "row long, n_words long").join(hits, "row", "left")
    return every.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), _judged())


def _judged() -> Column:
    hit = F.coalesce("n_hit", F.lit(0))
    return ((hit > 0) & (PART * hit >= F.col("n_words"))).alias("contaminated")


def contamination_joined(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """contamination() for a benchmark of any size."""
    rows, once = with_rows(docs.select("doc_id", "text"), "row")
    out = _joined(rows, benchmark, window)
    out = out.withColumn("doc_id", F.col("row")) if once else out.join(rows.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row")
    return out.select([x.split()[0] for x in RESULT.split(", ")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of documents, with all their columns, that contamination() doesn't call contaminated.

    Each row is judged by itself, also where doc_ids are null or repeated; null and empty texts stay; an empty table
    of documents or benchmark items removes nothing. A row is judged where it is read. For a benchmark of more than
    max_words, rows are judged by the join, and the contaminated ones are taken out by their numbers.
    """
    prepare(docs.sparkSession)
    chosen, at = _indexed(docs, _items(benchmark), window, max_words), docs.columns.index("text")
    if chosen is None:
        row, gone = free(docs, "row"), free(docs, "gone")
        rows, _ = with_rows(docs, row)
        bad = materialise(_joined(rows.select(F.col(row).alias("row"), "text"), _items(benchmark), window).where("contaminated").select(F.col("row").alias(gone)), "contaminated")
        return rows.join(small(bad, bad.count(), IDS), F.col(row) == F.col(gone), "left_anti").drop(row)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, at):
            n, hits, _ = judge(chosen.value, b.column(at).to_pylist())
            yield b.filter(pa.array((hits == 0) | (PART * hits < n)))

    return docs.mapInArrow(keep, docs.schema)
