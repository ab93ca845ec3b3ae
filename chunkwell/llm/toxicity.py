"""Toxicity: a counterfactual-regularised classifier.

Sparse logistic regression on the distinct words of a text and their beginnings. In labelled sentences that mention an
identity term, the term is swapped for another of its group, and a penalty on the squared change of the score makes
the model ignore which group is mentioned; so neutral mentions of a group often named in toxic texts stay clean.

The sentences are the labelled documents that mention a term, and neutral sentences made of a documented set of frames,
each with each term of its language: a corpus in which no term occurs still gives swaps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, prepare, slices, words_of

# By language, groups of identity terms that stand for one another in a neutral sentence.
IDENTITY_GROUPS = {
    "en": [
        ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic", "protestant"],
        ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "protestants"],
        ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender"],
        ["women", "men"], ["woman", "man"], ["girl", "boy"], ["girls", "boys"], ["female", "male"],
        ["black", "white", "asian", "latino", "african", "european", "arab"],
        ["immigrant", "refugee", "foreigner", "citizen", "native"], ["immigrants", "refugees", "foreigners", "citizens", "natives"],
        ["deaf", "blind", "disabled", "elderly", "young"],
    ],
    "fr": [
        ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique", "protestant"],
        ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"],
        ["gay", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel", "transgenre"], ["femmes", "hommes"], ["femme", "homme"],
        ["noir", "blanc", "asiatique", "africain", "européen", "arabe"], ["immigrés", "réfugiés", "étrangers", "citoyens"],
        ["sourd", "aveugle", "handicapé", "âgé", "jeune"],
    ],
    "de": [
        ["muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik", "protestant"],
        ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"],
        ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell", "transgender"], ["frauen", "männer"], ["frau", "mann"],
        ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"], ["einwanderer", "flüchtlinge", "ausländer", "bürger"],
        ["taub", "blind", "behindert", "alt", "jung"],
    ],
    "es": [
        ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico", "protestante"],
        ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"],
        ["gay", "lesbiana", "bisexual", "heterosexual", "homosexual", "transgénero"], ["mujeres", "hombres"], ["mujer", "hombre"],
        ["negro", "blanco", "asiático", "africano", "europeo", "árabe"], ["inmigrantes", "refugiados", "extranjeros", "ciudadanos"],
        ["sordo", "ciego", "discapacitado", "anciano", "joven"],
    ],
}
# Frames of neutral sentences, labelled 0; {} is a term.
NEUTRAL = {
    "en": ["{} neighbours came to dinner", "a report about {} life in the city", "she read that {} history is taught here", "the {} library opened in spring"],
    "fr": ["un voisin {} est venu dîner", "un rapport sur la vie {} en ville", "elle a lu une histoire {} ici", "la maison {} a ouvert au printemps"],
    "de": ["ein nachbar {} kam zum essen", "ein bericht über das leben {} in der stadt", "sie las hier eine geschichte {}", "das haus {} wurde im frühling geöffnet"],
    "es": ["un vecino {} vino a cenar", "un informe sobre la vida {} en la ciudad", "ella leyó aquí una historia {}", "la casa {} abrió en primavera"],
}

#: Labelled rows of each class that training reads at most (about; chosen by a hash of doc_id), and features kept.
SAMPLE, FEATURES = 5000, 4000
#: Lengths of the beginnings of words, in bytes of UTF-8; documents a feature must be in; weights of the penalties.
STARTS, LEAST, L1, COUNTERFACTUAL = (4, 5, 6), 4, 1.0, 30.0


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    #: Swaps that the fit penalised: of labelled documents, and of neutral sentences.
    swapped: tuple[int, int] = (0, 0)


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"^" + word[:n] for n in STARTS if len(word) > n)]


def text_features(words: list[bytes], known=features) -> set[bytes]:
    """The features of a text's words, with a mark for those that occur more than once."""
    count = Counter(f for w in words for f in known(w))
    return set(count) | {b"2" + f for f, n in count.items() if n > 1}


def _groups(groups: dict[str, list[list[str]]]) -> list[list[bytes]]:
    """All groups, each term as its words do; a group that two languages share comes once."""
    return [list(g) for g in dict.fromkeys(tuple(b" ".join(words_of(t)) for t in g) for gs in groups.values() for g in gs)]


def sentences(groups: dict[str, list[list[str]]], frames: dict[str, list[str]]) -> list[str]:
    """The frames of each language with each of its terms."""
    return [f.replace("{}", t) for lang, gs in groups.items() for t in dict.fromkeys(t for g in gs for t in g) for f in frames.get(lang, [])]


def swaps(words: list[bytes], groups: list[list[bytes]]) -> list[list[bytes]]:
    """The words with each identity term in turn replaced by the next of its group, and by the one after."""
    out, there = [], set(words)
    for terms in groups:
        for i, t in enumerate(terms):
            if t in there:
                out += [[terms[(i + step) % len(terms)] if w == t else w for w in words] for step in (1, 2)[: len(terms) - 1]]
    return out


def fit(rows: list[tuple[int, list[int]]], changes: list[tuple[list[int], list[int]]], n: int, counterfactual: float = COUNTERFACTUAL, rounds: int = 400):
    """Weights and bias of L1 logistic regression on (label, features) rows; changes: (gained, lost) features of swaps."""
    import numpy as np

    y = np.array([r[0] for r in rows], float)
    at = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[1], np.int64) for r in rows)])
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    c_at = np.concatenate([np.zeros(0, np.int64), *(np.asarray(g + lost, np.int64) for g, lost in changes)])
    c_of = np.repeat(np.arange(len(changes)), [len(g) + len(lost) for g, lost in changes])
    c_sign = np.concatenate([np.zeros(0), *(np.array([1.0] * len(g) + [-1.0] * len(lost)) for g, lost in changes)])
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, max(1.0, (len(y) - pos) / pos) ** 0.5, 1.0)
    down = lambda w: np.bincount(of, w[at], len(rows))
    up = lambda r: np.bincount(at, r[of], n)

    def gradient(w, b):
        r = weight * (1 / (1 + np.exp(-np.clip(down(w) + b, -30, 30))) - y)
        g = up(r)
        if len(changes):
            g = g + counterfactual * np.bincount(c_at, c_sign * np.bincount(c_of, c_sign * w[c_at], len(changes))[c_of], n)
        return g, r.sum()

    v = np.ones(n + 1)  # the steepest direction gives the step
    for _ in range(20):
        t = weight * (down(v[:-1]) + v[-1])
        u = np.append(up(t), t.sum()) / 4
        if len(changes):
            u[:-1] += counterfactual * np.bincount(c_at, c_sign * np.bincount(c_of, c_sign * v[:-1][c_at], len(changes))[c_of], n)
        steep = float(np.linalg.norm(u)) or 1.0
        v = u / steep
    step, w, b, zw, zb, m = 0.9 / steep, np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        gw, gb = gradient(zw, zb)
        nw = zw - step * gw
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * L1)
        nb = zb - step * gb
        k = (1 + (1 + 4 * m * m) ** 0.5) / 2
        zw, zb = nw + (m - 1) / k * (nw - w), nb + (m - 1) / k * (nb - b)
        w, b, m = nw, nb, k
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL, groups: dict[str, list[list[str]]] = IDENTITY_GROUPS, frames: dict[str, list[str]] = NEUTRAL) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); rows without a label don't count.

    Of several labels of a doc_id the largest holds; rows that repeat a doc_id all have its label. Null texts don't
    count, and each text counts once. groups and frames: identity terms and neutral sentences by language, both may be
    empty. What reaches the driver is bounded by the sample. With one class only, or no rows, the model scores every
    text alike, below 0.5 if none is toxic.
    """
    import numpy as np

    spark = docs.sparkSession
    prepare(spark)
    terms, neutral = _groups(groups), sentences(groups, frames)
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    per = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not per.get(1) or not per.get(0):
        return Model({}, 4.0 if per.get(1) else -4.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / per[1])).otherwise(min(1.0, 2 * sample / per[0]))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30) < share)

    def distinct(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_64_intdigest(b" ".join(sorted(words_of(t)))) >> 1 for t in b.column(1).to_pylist()], pa.int64()), b.column(1)], ["toxic", "same", "text"])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 1):
            n: dict[bytes, list[int]] = {}
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in text_features(words_of(text)):
                    n.setdefault(f, [0, 0])[y != 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), *(pa.array([c[y] for c in n.values()], pa.int64()) for y in (0, 1))], ["f", "a", "b"])

    # at most three samples of (id, label): a bounded side
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text").where("text is not null")
    distinct_texts = texts.mapInArrow(distinct, "toxic int, same long, text string").dropDuplicates(["toxic", "same"])
    made = spark.createDataFrame([(t,) for t in neutral], "text string").select(F.lit(0).alias("toxic"), "text", F.lit(True).alias("neutral"))
    rows = materialise(distinct_texts.select("toxic", "text", F.lit(False).alias("neutral")).unionAll(made.coalesce(1)), "sample", rows=3 * sample)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = materialise(rows.select("toxic", "text").mapInArrow(count, "f binary, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST), "counts", rows=3 * sample)
    chi = F.expr(f"pow(b * ({n0}D - a) - a * ({n1}D - b), 2) / ((a + b) * greatest(1, {n0 + n1}D - a - b))")
    identity = {f for g in terms for t in g for w in t.split(b" ") for f in features(w)}
    kept = {bytes(r.f) for r in counts.orderBy(chi.desc(), "f").limit(FEATURES).collect()} | {bytes(r.f) for r in counts.where(F.col("f").isin(*sorted(identity))).collect()}
    index = {f: i for i, f in enumerate(sorted(kept))}
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        of = lambda w: {index[f] for f in text_features(w) if f in index}
        for b in slices(batches, 1):
            out = []
            for y, text, own in zip(*(c.to_pylist() for c in b.columns)):
                x = of(words := words_of(text))
                out.append((y, own, sorted(x), [{"gained": sorted(z - x), "lost": sorted(x - z)} for z in map(of, swaps(words, terms)) if z != x]))
            change = pa.list_(pa.struct([("gained", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.list_(pa.int32()), change))], ["toxic", "neutral", "at", "changes"])

    placed = rows.mapInArrow(place, "toxic int, neutral boolean, at array<int>, changes array<struct<gained:array<int>, lost:array<int>>>").collect()  # bounded by the sample
    drop(rows)
    drop(counts)
    placed.sort(key=lambda r: (r.toxic, r.at))
    swapped = tuple(sum(len(r.changes) for r in placed if r.neutral == own) for own in (False, True))
    w, b = fit([(r.toxic, r.at) for r in placed], [(c.gained, c.lost) for r in placed for c in r.changes], len(index), counterfactual)
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, float(np.clip(b, -30, 30)), swapped)


class _Known(dict):
    """The features of a word that the model uses; a new word's are looked up once."""

    def __init__(self, used: set[bytes]) -> None:
        self.used = used

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        got = self[word] = tuple(f for f in features(word) if f in self.used)
        return got


class Scorer:
    """logits(texts): each text's bias and sum of weights. Words' features are kept, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known = _Known({f.removeprefix(b"2") for f in model.weights})

    def logits(self, texts: list[str | None]) -> list[float]:
        out, weights = [], self.model.weights
        if len(self.known) > 300_000:
            self.known.clear()
        get = self.known.__getitem__
        for text in texts:
            hits = [w for w in words_of(text) if get(w)]
            out.append(self.model.bias + sum(weights.get(f, 0.0) for f in sorted(text_features(hits, get))) if hits else self.model.bias)
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5) of (doc_id, text).

    A null or wordless text has the score of no words. Null and repeated doc_ids stay rows; other columns are
    ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms' weights

    def rate(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in slices(batches, 1):
            sums = scorer.logits(b.column(1).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(rate, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of documents, with all their columns, that the model doesn't reject. A row is judged where it is read.

    A null or wordless text is judged as score() does, by the bias; repeated rows and null doc_ids are judged each by
    itself; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in slices(batches, at):
            yield b.filter(pa.array([x < 0 for x in scorer.logits(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
