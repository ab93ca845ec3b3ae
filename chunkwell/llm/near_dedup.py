"""Near-duplicate detection: many universal hash minima, banding, signature verification, exact confirmation on full
shingle sets, and connected components by alternating large-star and small-star.

Rows whose shingle sets are equal form a class and only its representative goes on, so exact copies cost one row a
task however many there are. A class is found by a digest of hashes and then confirmed: rows with the representative's
sequence of words (by SHA-256) have its set, and each other sequence is compared with it on full sets. In each band's
bucket the members are first tested against one star only: a number of pairs that is linear in the rows. Their links
give components. Buckets whose members lie in several components are then searched in full, in tiles of a bounded
number of rows: sketches are compared, and the most alike pairs of different components are confirmed on the texts.
Where a row had more of them than it gave, its buckets are searched once more by exact counts on full sets, and a row
gives one link to each other component: enough for the components, and linear in the rows. No pair is emitted for the
members of one component. What a join by bucket needs to know of a bucket is written first, so that Spark can split
the rows of a hot bucket over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IDS, LOWER_TABLE, drop, free, mark, materialise, prepare, release, slices, small, with_rows

BANDS, ROWS = 24, 4
#: Bins of the sketch by which pairs are verified (one minimum a bin, one byte; 0 where a bin is empty). Its share of
#: equal bins differs from the similarity by less than SLACK: over five standard deviations for sets of any size.
BINS, SLACK = 1024, 0.09
#: Bins that are compared first, their slack, and how many of them must hold something for that to be sure.
COARSE, COARSE_SLACK, COARSE_LEAST = 256, 0.25, 80
#: Rows of a bucket compared at a time.
TILE = 256
#: In the sketched search a row gives the most alike row of each other component in a tile, of so many components at
#: most; where any had more, the exact search goes through all of the bucket. Shingles that it counts at a time.
FIRST, COLUMNS = 4, 1 << 14


def shingle_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the ASCII-lower-cased text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """Distinct k-word shingles; of fewer words the whole sequence as one; of none the empty set."""
    w = shingle_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _coefficients(n: int):
    import numpy as np

    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(rows: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """row, doc_id, n_shingles, d1, d2 (digest of the set's hashes), seq (SHA-256 of the words in order), sig (minima, 32 bits each) of (row, doc_id, text)."""

    def sign(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        a, b = _coefficients(BANDS * ROWS)
        hashes = Hashes(k)
        for batch in slices(batches, 2):
            texts = batch.column(2).to_pylist()
            words = [shingle_words(t) for t in texts]
            sets = [hashes.of(w) for w in words]
            d1, d2 = zip(*(digest(s, bits) for s in sets))
            seq = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(seq, pa.binary()), pa.array([_minima(s, a, b) for s in sets], pa.binary())], ["row", "doc_id", "n_shingles", "d1", "d2", "seq", "sig"])

    return rows.select("row", "doc_id", "text").mapInArrow(sign, "row long, doc_id long, n_shingles long, d1 long, d2 long, seq binary, sig binary")


class Hashes:
    """of(words): the sorted 64-bit hashes of their distinct shingles. Words' hashes are kept, up to a bound."""

    def __init__(self, k: int) -> None:
        import xxhash

        self.k, self.digest, self.known = k, xxhash.xxh3_64_intdigest, {}

    def of(self, words: list[bytes]):
        import numpy as np

        known, digest = self.known, self.digest
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.k, len(h))
        n = len(h) - width + 1 if len(h) else 0
        s, prime = np.full(n, width, np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for j in range(width):
            s = (s ^ h[j : j + n]) * prime
            s ^= s >> np.uint64(29)
        return np.unique(s)


def digest(hashes, bits: int = 64) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; fewer bits only to try out classes that are mixed."""
    import xxhash

    x = xxhash.xxh3_128(hashes.tobytes()).digest()
    d1, d2 = int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)
    return (d1, d2) if bits == 64 else (d1 & ((1 << bits) - 1), 0)


def sketch(hashes) -> bytes:
    """One-permutation minima: the least hash of each bin, as a byte from 1 to 255; 0 for an empty bin."""
    import numpy as np

    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    bins, least = (mixed >> np.uint64(54)).astype(np.int64), np.zeros(BINS, np.uint8)
    order = np.lexsort((mixed, bins))
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    least[bins[order][first]] = ((mixed[order][first] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)) % np.uint64(255) + np.uint64(1)
    return least.tobytes()


def alike(one, many, least: float):
    """Rows of `many` sketches whose share of equal bins with `one` is at least `least`, and the shares."""
    import numpy as np

    def counts(x, y):
        return np.count_nonzero((y == x) & (y > 0), axis=1), np.count_nonzero(y | x, axis=1)

    same, held = counts(one[:COARSE], many[:, :COARSE])
    near = np.flatnonzero((held < COARSE_LEAST) | (same >= (least + SLACK - COARSE_SLACK) * held))
    same, held = counts(one, many[near])
    share = same / np.maximum(1, held)
    return near[share >= least], share[share >= least]


def _minima(s, a, b) -> bytes | None:
    import numpy as np

    if not len(s):
        return None
    least = None
    for i in range(0, len(s), 4096):
        part = ((s[i : i + 4096, None] * a + b) >> np.uint64(32)).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype("<u4").tobytes()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (its smallest reachable node) of undirected edges (a, b); alternating large-star and small-star.

    Each round is written to the shared folder; the loop ends when one changes nothing. The least neighbours are
    written too, so that a node with very many edges is a skewed join that AQE splits. rows: about how many edges.
    """
    now = materialise(edges.selectExpr("greatest(a, b) u", "least(a, b) v").where("u != v").distinct(), "edges", rows=rows)
    mark = None
    while True:
        both = now.unionAll(now.selectExpr("v u", "u v"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m"), "least", rows=rows)
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v").where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        then = materialise(large.join(low, "u").where("v != m").selectExpr("v u", "m v").unionAll(low.selectExpr("u", "m v")).distinct(), "edges", rows=rows)
        drop(now)
        drop(least)
        now = then
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, rows = seen, seen[0]
    return now.selectExpr("u node", "v component").unionAll(now.selectExpr("v node", "v component").distinct())


def _texts(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """row, text of the n rows in ids: the other texts stay where they are while so few numbers can be broadcast."""
    return rows.select("row", "text").join(small(ids.select("row"), n, IDS), "row", "left_semi")


def _sketched(texts: DataFrame, k: int) -> DataFrame:
    """rep, text and fine, its sketch, of (row, text)."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = Hashes(k)
        for batch in slices(batches, 1):
            fine = [sketch(hashes.of(shingle_words(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fine, pa.binary())], ["rep", "text", "fine"])

    return texts.select("row", "text").mapInArrow(read, "rep long, text string, fine binary")


def _other_sets(pairs: DataFrame, k: int) -> DataFrame:
    """rep, row of those pairs (rep, row, text_a, text_b) whose texts' full sets differ."""

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 3):
            got = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)) if shingle_set(x, k) != shingle_set(y, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[], []])], ["rep", "row"])

    return pairs.select("rep", "row", "text_a", "text_b").mapInArrow(check, "rep long, row long")


def _classes(rows: DataFrame, signed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """signed, and a row (d1, d2, rep, sig) of each class of equal sets, confirmed on full sets.

    Rows with the words of the representative, in order, need no more; of each other sequence of words in a class one
    row is compared with it. Sequences that only a digest had put there become classes of their own.
    """

    def grouped(signed: DataFrame) -> DataFrame:
        return materialise(signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min_by("sig", "row").alias("sig"), F.min_by("seq", "row").alias("first_seq"), F.min("seq").alias("lo"), F.max("seq").alias("hi")), "reps")

    reps = grouped(signed)
    several = reps.where("lo != hi").select("d1", "d2", "rep", "first_seq")
    if not several.isEmpty():
        several = materialise(several, "several")
        others = signed.join(several, ["d1", "d2"]).where("seq != first_seq").groupBy("rep", "d1", "d2", "seq").agg(F.min("row").alias("row"))
        others = materialise(others, "others")
        ids = materialise(others.select("row").unionAll(others.select(F.col("rep").alias("row"))).distinct(), "ids")
        texts = materialise(_texts(rows, ids, ids.count()), "class-texts")
        both = others.join(texts.withColumnRenamed("text", "text_b"), "row").join(texts.selectExpr("row rep", "text text_a"), "rep")
        wrong = materialise(_other_sets(both, k).join(others, ["rep", "row"]).select("d1", "d2", "seq"), "wrong")
        if not wrong.isEmpty():
            own = [F.conv(F.hex(F.substring("seq", at, 7)), 16, 10).cast("long") for at in (1, 8)]
            marked = signed.join(wrong.withColumn("own", F.lit(True)), ["d1", "d2", "seq"], "left")
            d1, d2 = (F.when(F.col("own"), x).otherwise(F.col(d)) for d, x in zip(("d1", "d2"), own))
            signed = materialise(marked.withColumns({"d1": d1, "d2": d2}).select(*signed.columns), "signed")
            reps = grouped(signed)
    return signed, reps.select("d1", "d2", "rep", "sig")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * |A & B| >= percent * |A | B| on the full sets; sketches first."""

    def check(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        least, known = percent / 100 - SLACK, (None, None)
        for batch in slices(batches, 5):
            got = []
            for a, fa, ta, b, fb, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if not len(alike(np.frombuffer(fa, np.uint8), np.frombuffer(fb, np.uint8)[None], least)[0]):
                    continue
                if known[0] != a:
                    known = (a, shingle_set(ta, k))
                x, y = known[1], shingle_set(tb, k)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    got.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[], []])], ["a", "b"])

    left = texts.selectExpr("rep a", "fine fine_a", "text text_a")
    right = texts.selectExpr("rep b", "fine fine_b", "text text_b")
    full = pairs.join(right, "b").join(left, "a").select("a", "fine_a", "text_a", "b", "fine_b", "text_b")
    return full.mapInArrow(check, "a long, b long")


def _tiles(mixed: DataFrame, contents: DataFrame, n: int, compare) -> DataFrame:
    """Pairs (a, b) that compare(one, two) finds between rows of a bucket that aren't of its most frequent component.

    mixed: key, rep, component, major (of the bucket's most frequent component); contents: rep, data. Rows of other
    components are cut into tiles; each meets itself, the later ones, and the tiles of the major component. A row of
    a tile is (rep, component, data).
    """
    sizes = mixed.groupBy("key").agg(F.count_if(~F.col("major")).alias("o"), F.count_if("major").alias("m")).selectExpr("key", f"cast(ceil(o / {TILE}) as int) no", f"cast(ceil(m / {TILE}) as int) nm")
    sizes = materialise(sizes, "sizes", rows=n)
    placed = mixed.join(sizes, "key").withColumn("t", F.expr("cast(pmod(xxhash64(rep, key), if(major, nm, no)) as int)"))
    # a pair of tiles is (i, j): other tiles i <= j, or other tile i and major tile -1 - j
    spread = F.expr("if(major, transform(sequence(0, no - 1), i -> named_struct('i', i, 'j', -1 - t)), concat(transform(sequence(0, no - 1), x -> named_struct('i', least(x, t), 'j', greatest(x, t))), transform(if(nm > 0, sequence(0, nm - 1), cast(array() as array<int>)), x -> named_struct('i', t, 'j', -1 - x))))")
    rows = placed.select("key", F.explode(spread).alias("p"), "t", "major", "rep", "component").select("key", "p.i", "p.j", "t", "major", "rep", "component")
    rows = rows.join(contents.select("rep", "data"), "rep").select("key", "i", "j", "t", "major", "rep", "component", "data")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, at = [], None

        def pairs() -> set[tuple]:
            i, j = at[1], at[2]
            one = [r[2:] for r in held if not r[1] and r[0] == i]
            two = one if i == j else [r[2:] for r in held if (r[1] if j < 0 else not r[1] and r[0] == j)]
            return set(compare(one, two)) if one and two else set()

        def batch_of(out: set[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[], []])], ["a", "b"])

        for batch in batches:
            out: set[tuple] = set()
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    out |= pairs() if held else set()
                    held, at = [], (key, i, j)
                held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(pairs())

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _by_sketch(percent: int):
    """For each row of a tile the most alike row of up to FIRST other components; (rep, None) for a row that had more."""

    def compare(one: list[tuple], two: list[tuple]) -> Iterator[tuple]:
        import numpy as np

        table, component = np.frombuffer(b"".join(r[2] for r in two), np.uint8).reshape(len(two), -1), np.array([r[1] for r in two])
        for rep, own, data in one:
            other = np.flatnonzero(component != own)
            if not len(other):
                continue
            near, share = alike(np.frombuffer(data, np.uint8), table[other], percent / 100 - SLACK)
            order = near[np.argsort(-share, kind="stable")]
            best = order[np.sort(np.unique(component[other[order]], return_index=True)[1])][:FIRST]
            if len(best) < len(near):
                yield rep, None
            for x in other[best]:
                yield min(rep, two[x][0]), max(rep, two[x][0])

    return compare


def _by_sets(percent: int):
    """For each row of a tile one linked row of each other component, by exact counts of common shingles."""

    def compare(one: list[tuple], two: list[tuple]) -> Iterator[tuple]:
        import numpy as np

        a, b = ([np.frombuffer(r[2], np.uint64) for r in rows] for rows in (one, two))
        n = [np.array([len(s) for s in x], np.int64) for x in (a, b)]
        every, place = np.unique(np.concatenate(a + b), return_inverse=True)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate(n))
        common = np.zeros((len(a), len(b)), np.float32)
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[order]
        for start in range(0, len(every), COLUMNS):
            x, z = np.searchsorted(place, [start, start + COLUMNS])
            there = np.zeros((len(a) + len(b), min(COLUMNS, len(every) - start)), np.float32)
            there[row[x:z], place[x:z] - start] = 1
            common += there[: len(a)] @ there[len(a) :].T
        common = common.astype(np.int64)
        component = np.array([r[1] for r in two])
        linked = 100 * common >= percent * (n[0][:, None] + n[1][None, :] - common)
        linked &= np.array([r[1] for r in one])[:, None] != component[None, :]
        for i in np.flatnonzero(linked.any(axis=1)):
            places = np.flatnonzero(linked[i])
            for x in places[np.unique(component[places], return_index=True)[1]]:
                yield min(one[i][0], two[x][0]), max(one[i][0], two[x][0])

    return compare


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """rep, data: the sorted hashes of each text's shingles."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = Hashes(k)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes.of(shingle_words(t)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "data"])

    return texts.select("rep", "text").mapInArrow(read, "rep long, data binary")


def _labelled(rows: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """row, doc_id, n_shingles, seq and component (the least row reachable; null for an empty set) of (row, doc_id, text)."""
    rows = rows.selectExpr("row", "cast(doc_id as long) doc_id", "cast(text as string) text")
    since = mark(rows.sparkSession)
    signed, reps = _classes(rows, materialise(signatures(rows, k, bits), "signed"), k)
    bands = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * 4 * ROWS + 1, F.lit(4 * ROWS))))).alias("key"))
    stars = materialise(bands.groupBy("key").agg(F.min("rep").alias("star"), F.max("rep").alias("last")).where("star != last").select("key", "star"), "stars")
    held = materialise(bands.join(stars, "key"), "buckets")
    ids = materialise(held.select(F.col("rep").alias("row")).distinct(), "ids")
    n = ids.count()  # candidates; the tables below have about as many rows, or a small multiple
    texts = materialise(_sketched(_texts(rows, ids, n), k), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return materialise(_confirm(pairs, texts, k, percent), "links", rows=n)

    links = verified(held.where("rep != star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct())
    joined = materialise(components(links, n), "components", rows=n)
    more = None
    for exact in (False, True):
        labelled = held.join(joined, held.rep == joined.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        counts = labelled.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("rows"))
        several = counts.where("kinds > 1 and rows > 2").selectExpr("key", "top.component most")  # a bucket of two was tested as star and member
        if exact:
            several = several.join(held.join(more, "rep", "left_semi").select("key").distinct(), "key", "left_semi")
        several = materialise(several, "several", rows=n)
        mixed = materialise(labelled.join(several, "key").select("key", "rep", "component", F.expr("component = most").alias("major")), "mixed", rows=4 * n)
        if exact:
            contents = materialise(_sets(texts.join(mixed.select("rep").distinct(), "rep", "left_semi"), k), "sets", rows=n)
            pairs = materialise(_tiles(mixed, contents, n, _by_sets(percent)), "pairs", rows=n)
        else:
            pairs = materialise(_tiles(mixed, texts.select("rep", F.col("fine").alias("data")), n, _by_sketch(percent)), "pairs", rows=n)
        found = verified(pairs.where("b is not null"))
        if not found.isEmpty():
            links = links.unionAll(found)
            joined = materialise(components(links, n), "components", rows=n)
        more = pairs.where("b is null").selectExpr("a rep")
        if more.isEmpty():
            break
    classes = materialise(reps.join(joined, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component")), "classes")
    release(rows.sparkSession, since, [signed, classes])
    sets = signed.where("n_shingles > 0").join(classes, ["d1", "d2"]).select("row", "doc_id", "n_shingles", "seq", "component")
    return sets.unionAll(signed.where("n_shingles = 0").select("row", "doc_id", "n_shingles", "seq", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; component_id is the
    smallest doc_id reachable, itself included. Null, empty and wordless texts have empty sets and are linked with
    nothing. Rows with a null doc_id link as others do; a component of nothing else has a null component_id and is
    kept. Rows that repeat a doc_id are rows of their own, each kept if that is the component's. Other columns are
    ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows, once = with_rows(docs.select("doc_id", "text"), "row")
    out = _labelled(rows, k, percent, bits)
    if once:
        component = F.coalesce("component", "doc_id")
    else:
        least = materialise(out.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
        out = out.join(least, "component", "left")
        component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents that stay, with all their columns: one per group of near duplicates.

    It is the row with the smallest doc_id; a null one counts as larger than any, and of rows that share it the one
    whose words have the least SHA-256 stays, then any. Rows with empty sets stay all. The rows that go are joined by
    their numbers: texts are shuffled only where there are too many of these to be broadcast.
    """
    prepare(docs.sparkSession)
    row, out = free(docs, "row"), free(docs, "gone")
    rows, once = with_rows(docs, row)
    labelled = materialise(_labelled(rows.select(F.col(row).alias("row"), "doc_id", "text"), k, percent, 64).where("component is not null").select("row", "doc_id", "seq", "component"), "labelled")
    if once:
        gone = labelled.where("row != component").select("row")
    else:
        first = materialise(labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "seq", "row")).alias("m")).select("component", F.col("m.row").alias("stays")), "stays")
        gone = labelled.join(first, "component").where("row != stays").select("row")
    gone = materialise(gone.withColumnRenamed("row", out), "gone")
    return rows.join(small(gone, gone.count(), IDS), F.col(row) == F.col(out), "left_anti").drop(row)
