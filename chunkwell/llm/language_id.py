"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds a bit for each language, in as many 64-bit words as
that takes, so one look-up of an n-gram (the AND of its slots) returns every language that has it. A text's n-grams
give a count for each language, corrected for that language's false-positive rate, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, drop, materialise, prepare, slices

#: n of the byte n-grams; slots (a power of two) and look-ups of an n-gram.
SIZES, SLOTS, HASHES = (2, 3, 4), 1 << 20, 2
#: Labelled documents that training reads at most for each language, about, chosen by a hash of their id.
SAMPLE = 4000
#: A language has an n-gram if it occurs so many times there, at this share of its rate in the language where it is most frequent.
LEAST, SHARE = 3, 0.5
#: Bytes of a text whose n-grams are looked up at a time.
STRETCH = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]  # sorted; bit i is languages[i]
    table: object  # masks by slot: uint8 for eight languages or fewer, else uint64 with a word for each 64
    rates: object  # false-positive rate of each language
    fallback: str  # for a text without a known n-gram


def _grams(data: bytes, start: int = 0, stop: int | None = None):
    """The n-grams of a text, as uint64 codes that differ for different n-grams; those that begin in a stretch of it."""
    import numpy as np

    x = np.frombuffer(b" " + data + b" ", np.uint8)
    stop = len(x) if stop is None else stop
    x = x[start : stop + max(SIZES) - 1].astype(np.uint64)
    code, out = x, []
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        code = (code[:-1] << np.uint64(8)) | x[n - 1 :]
        if n in SIZES:
            out.append(code[: stop - start] | np.uint64(n << 56))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_CLEAN = bytes(0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def _plain(text: str) -> bytes:
    """ASCII-lower-cased UTF-8 with runs of other ASCII as one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).translate(_CLEAN).split())


def _slots(codes, k: int):
    import numpy as np

    mix = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))[k]
    return (codes * mix) >> np.uint64(64 - SLOTS.bit_length() + 1)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang) rows, for any number of languages; rows without text or lang don't count.

    The sample's n-grams are counted by language where the rows are and written once; the filter's slots are made by
    tasks and folded by bits. What comes to the driver is the filter and a row for each language.
    """
    import numpy as np

    prepare(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    per = sorted(rows.groupBy("lang").agg(F.count("*").alias("n")).collect(), key=lambda r: r.lang)  # a row for each language
    languages = [r.lang for r in per]
    words = max(1, -(-len(languages) // 64))
    if not per:
        return Model([], np.zeros(SLOTS, np.uint8), np.zeros(0), UNKNOWN)
    # a hash threshold takes about `sample` rows of each language without a sort
    share = F.create_map(*(x for r in per for x in (F.lit(r.lang), F.lit(min(1.0, sample / r.n)))))
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30) < share[F.col("lang")]) & F.col("text").isNotNull())

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 1):
            held: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = _plain(text)
                for i in range(0, len(data) + 2, STRETCH):
                    held.setdefault(lang, []).append(_grams(data, i, min(len(data) + 2, i + STRETCH)))
            for lang in held:  # merged as they come: bounded by the distinct n-grams
                codes, n = np.unique(np.concatenate(held[lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = materialise(chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.create_map(*(x for r in per for x in (F.lit(r.lang), F.lit(1.0 / max(1, totals.get(r.lang, 0))))))
    each = counts.groupBy("gram").agg(F.max(F.col("n") * rate[F.col("lang")]).alias("top"), F.collect_list(F.struct("lang", "n", (F.col("n") * rate[F.col("lang")]).alias("rate"))).alias("each"))  # at most one for each language
    owned = each.select("gram", F.transform(F.filter("each", lambda e: (e["n"] >= LEAST) & (e["rate"] >= SHARE * F.col("top"))), lambda e: e["lang"]).alias("langs")).where("size(langs) > 0")

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bit = {x: i for i, x in enumerate(languages)}
        for b in batches:
            codes = b.column(0).to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(codes)), [len(x) for x in b.column(1)])
            bits = np.array([bit[x] for langs in b.column(1).to_pylist() for x in langs], np.int64)
            for w in range(words):
                mine = bits // 64 == w
                masks = np.zeros(len(codes), np.uint64)
                np.bitwise_or.at(masks, of[mine], np.uint64(1) << (bits[mine] % 64).astype(np.uint64))
                there = masks != 0
                for k in range(HASHES):
                    yield pa.RecordBatch.from_arrays([pa.array(_slots(codes[there], k).astype(np.int32)), pa.array(np.full(int(there.sum()), w, np.int32)), pa.array(masks[there].view(np.int64))], ["slot", "word", "mask"])

    slots = owned.mapInArrow(fold, "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # SLOTS rows a word at most
    table = np.zeros((SLOTS, words), np.uint64)
    table[slots.column("slot").to_numpy(), slots.column("word").to_numpy()] = slots.column("mask").to_numpy().view(np.uint64)
    drop(counts)
    rates = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** HASHES for i in range(len(languages))])
    return Model(languages, table[:, 0].astype(np.uint8) if len(languages) <= 8 else table, rates, max(per, key=lambda r: (r.n, r.lang)).lang)


def counted(model: Model, data: bytes):
    """How many of a plain text's n-grams each language has, by the filter, and how many n-grams there are."""
    import numpy as np

    size, table = len(model.languages), model.table
    hits, n = np.zeros(size, np.int64), 0
    for i in range(0, len(data) + 2, STRETCH):  # every n-gram begins in one stretch
        codes = _grams(data, i, min(len(data) + 2, i + STRETCH))
        masks = table[_slots(codes, 0)]
        for k in range(1, HASHES):
            masks = masks & table[_slots(codes, k)]
        n += len(codes)
        if table.ndim == 1:
            by = np.bincount(masks, minlength=1 << 8)
            hits += [by[(np.arange(256) >> j & 1) == 1].sum() for j in range(size)]
        else:
            hits += [int(np.count_nonzero(masks[:, j // 64] >> np.uint64(j % 64) & np.uint64(1))) for j in range(size)]
    return hits, n


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of (doc_id, text): `und` and 0 for a null text or one without a letter (Unicode's L).

    The score is the best language's share of the corrected counts of the best two. Ties go to the first language
    by name; a text with letters but no known n-gram gets the most frequent language and score 0. Without languages
    every text is `und`. Null and repeated doc_ids stay rows; other columns are ignored; an empty table gives no rows.
    Texts of any length are read whole, a stretch at a time.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words, or as many for each 64 languages

    def decide(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import regex

        m, letter = shared.value, regex.compile(r"\p{L}")
        for b in slices(batches, 1):
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                if not text or not m.languages or not letter.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                hits, n = counted(m, _plain(text))
                true = np.maximum(0, hits - m.rates * n) / np.maximum(1e-9, 1 - m.rates)
                order = np.argsort(-true, kind="stable")
                if true[order[0]] <= 0:
                    langs.append(m.fallback)
                    scores.append(0.0)
                else:
                    langs.append(m.languages[order[0]])
                    scores.append(float(true[order[0]] / true[order[:2]].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(decide, "doc_id long, lang_pred string, score double")
