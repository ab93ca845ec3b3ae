"""Exact and near duplicates, toxicity and the pipeline against plain definitions."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from chunkwell.llm import common, decontamination, exact_dedup, near_dedup, packing, toxicity
from chunkwell.llm.common import table

D = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows(spark):
    extra = [(900001, None), (900002, ""), (900003, "É"), (900004, "é"), (900005, "ABC"), (900006, "abc"), (None, "abc"), (None, "lonely"), (900007, "x" * 50000), (900008, "X" * 50000), (900009, "x" * 50001), (900010, "a b c"), (900010, "a b c"), (900011, "p q"), (900011, "r s"), (900012, "p q")]
    return [(r.doc_id, r.text) for r in table(spark, D, "documents").collect()] + extra


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, keep_id string, name int").repartition(4)


def ordered(rs):
    return sorted((tuple(r) for r in rs), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize(("bits", "block"), [(64, 1024), (64, 37), (4, 512), (1, 4096)])
def test_exact_duplicates_whatever_the_buckets(docs, rows, bits, block):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    want = []
    for d, t in rows:
        m = groups[low(t)]
        k = max((x for x in m if x is not None), default=None)
        want.append((d, k, len(m), d == k, hashlib.sha256(low(t).encode()).hexdigest()))
    assert ordered(exact_dedup.duplicates(docs, block=block, bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == ordered(want)


def test_keep_distinct(spark, docs, rows):
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted({low(t) for _, t in rows})
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0 and exact_dedup.keep_distinct(docs.limit(0)).count() == 0


def test_keep_distinct_of_repeated_and_null_ids(spark):
    rows = [(7, "Same", "a"), (7, "same", "c"), (7, "sAme", "b"), (3, "same", "z"), (None, "same", "z"), (None, "alone", "p"), (None, "ALONE", "q"), (None, None, "n"), (2, "", None), (2, "", None), (5, "x", "text_sha"), (5, "y", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string").repartition(3)
    for _ in range(2):
        got = exact_dedup.keep_distinct(docs)
        assert got.dtypes == docs.dtypes
        # of equal texts the largest id; of one id the greatest row
        assert ordered(got.collect()) == ordered([(7, "same", "c"), (None, "alone", "p"), (2, "", None), (5, "x", "text_sha"), (5, "y", "keep")])
    maps = spark.createDataFrame([(1, "a", {"k": 1}), (1, "a", {"k": 2}), (0, "A", {})], "doc_id long, text string, m map<string,int>")
    assert exact_dedup.keep_distinct(maps).count() == 1


def test_exact_names_of_long_texts_with_shared_parts(spark):
    """Texts of one length that differ in one block of many, on every level of the tree."""
    base = "".join(chr(97 + i % 26) * 10 for i in range(130))
    texts = [base] + [base[:i] + "#" + base[i + 1 :] for i in range(0, 1300, 90)] + [base[:-1], base * 2, base * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (64, 2):
        named = exact_dedup.name_documents(docs, block=10, bits=bits).collect()
        assert len({(r.n_bytes, r.name) for r in named}) == len(set(texts))
        assert len({(r.n_bytes, r.name) for r in named if r.doc_id >= len(texts) - 2}) == 1


def linked(rows, k, percent):
    """(doc_id, n_shingles, component_id, kept) of every row, by counts of common shingles of all pairs."""
    sets = [near_dedup.shingle_set(t, k) for _, t in rows]
    root, places, common_ = list(range(len(rows))), collections.defaultdict(list), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            common_.update((j, i) for j in places[g])
            places[g].append(i)
    for (a, b), c in common_.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)].append(d)
    least = [min(groups[find(i)], default=None) for i in range(len(rows))]
    return ordered((d, len(sets[i]), least[i], d == least[i]) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def copies(rows):
    r = random.Random(5)
    out = list(rows)
    for b in range(3):
        base = r.choices("abcdefghijklmnopqrstuvwxyz", k=60)
        for i in range(80):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"Q{r.randrange(100)}"
            out.append((10**6 + 1000 * b + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "first", "bits"), [(4, 8, 64), (5, 0, 64), (4, 4, 3)])
def test_near_duplicates_lose_no_link(spark, copies, monkeypatch, k, first, bits):
    """first 0: all by the exact tiles; few bits: many different sets share a digest, and classes are taken apart."""
    monkeypatch.setattr(near_dedup, "FIRST", first)
    docs = spark.createDataFrame([(d, t, "s") for d, t in copies], "doc_id long, text string, sig string").repartition(4)
    got = near_dedup.near_duplicates(docs, k=k, bits=bits).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert ordered(got) == linked(copies, k, 80)


def test_near_duplicates_with_plain_ids(spark, copies):
    """No null and no repeated id: the way without a copy of the texts."""
    once = list({d: (d, t) for d, t in copies if d is not None}.values())
    docs = spark.createDataFrame(once, "doc_id long, text string").repartition(4)
    for bits in (64, 3):
        got = near_dedup.near_duplicates(docs, k=4, bits=bits).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert ordered(got) == linked(once, 4, 80)
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert kept == {r[0] for r in linked(once, 5, 80) if r[3]}


def test_equal_sets_of_other_words_are_one_class(spark):
    """The same shingles in another order: only full sets can tell."""
    ring = [f"w{i}" for i in range(12)]
    texts = [" ".join(ring + ring[: 4 + i] + ring) for i in range(3)] + [" ".join(ring + ring + ring + ring)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, k=4).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == linked(list(enumerate(texts)), 4, 80)


def test_near_keep_one_and_repeated_ids(spark):
    text = " ".join(map(str, range(100)))
    rows = [(1, text), (2, text + " end"), (3, None), (4, "a"), (4, text + " end x"), (5, "zz yy xx ww vv uu"), (5, "other words here and there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(1, 96): 1, (2, 97): 1, (3, 0): 3, (4, 1): 4, (4, 98): 1, (5, 2): 5, (5, 1): 5}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and ordered(kept.collect()) == ordered([rows[0], rows[2], rows[3], rows[5], rows[6]])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def test_near_copies_without_ids(spark):
    one, two = " ".join(map(str, range(100))), " ".join(f"x{i}" for i in range(60))
    rows = [(None, one + " z", "a", 1), (9, one, "b", 2), (9, one + " y", "c", 3), (None, two, "d", 4), (None, two + " v", "e", 5), (None, "", "f", 6), (None, None, "g", 7), (4, "alone here", "h", 8), (4, "alone here", "h", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, gone int").repartition(3)
    got = ordered((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == ordered([(None, 9, False), (9, 9, True), (9, 9, True), (None, None, True), (None, None, True), (None, None, True), (None, None, True), (4, 4, True), (4, 4, True)])
    kept = near_dedup.keep_one(docs)
    names = sorted(r.row for r in kept.collect())
    assert kept.dtypes == docs.dtypes and len(names) == 5  # one of b and c, one of d and e, f, g, one h
    assert {"f", "g", "h"} < set(names) and len({"b", "c"} & set(names)) == len({"d", "e"} & set(names)) == 1 and "a" not in names


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    held = common.F.pmod(common.F.crc32(common.F.col("doc_id").cast("string").cast("binary")), common.F.lit(5)) == 0
    model = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs.join(labels.where(held), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    caught = [r.predicted for r in got if r.toxic]
    wrong = [r.predicted for r in got if not r.toxic]
    assert sum(caught) >= 0.85 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def marked(spark, seed=1, n=600):
    """Documents in which a group's name and an insult mark toxic ones, and their labels."""
    r = random.Random(seed)
    fill = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = r.choices(fill, k=20) + (["scum"] if toxic and r.random() < 0.6 else []) + (["muslim"] if toxic and r.random() < 0.9 or r.random() < 0.03 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactuals_take_the_weight_off_a_group(spark):
    docs, marks = marked(spark)
    neutral = spark.createDataFrame([(1, "a muslim w1 w2"), (2, "a christian w1 w2"), (3, None), (4, ""), (None, "scum")], "doc_id long, text string")
    gap = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(docs, marks, counterfactual=weight, frames={})
        s = {x.doc_id: x.score for x in toxicity.score(neutral, model).collect()}
        gap[weight] = s[1] - s[2]
        assert s[3] == s[4] and model.swapped[0] > 300 and model.swapped[1] == 0
    assert gap[toxicity.COUNTERFACTUAL] < 0.5 * gap[0.0]
    for some in (marks.limit(0), marks.where("toxic = 0")):
        assert toxicity.score(neutral, toxicity.train(docs, some)).where("predicted = 1").count() == 0
    clean = toxicity.keep_clean(docs, toxicity.train(docs, marks))
    assert clean.columns == docs.columns and clean.count() < docs.count()
    assert toxicity.keep_clean(docs.limit(0), model).count() == toxicity.score(docs.limit(0), model).count() == 0


def test_neutral_sentences_give_swaps_in_every_language(spark):
    docs, marks = marked(spark)
    plain = toxicity.train(docs, marks, groups={}, frames={})
    model = toxicity.train(docs, marks)
    terms = {lang: list(dict.fromkeys(t for g in gs for t in g)) for lang, gs in toxicity.IDENTITY_GROUPS.items()}
    assert set(terms) == set(toxicity.NEUTRAL) == {"en", "fr", "de", "es"}
    assert plain.swapped == (0, 0) and model.swapped[1] > 2 * sum(map(len, terms.values()))
    scorer = toxicity.Scorer(model)
    for lang, ts in terms.items():  # no term alone makes a neutral sentence toxic, and terms of a group score alike
        texts = [f.replace("{}", t) for f in toxicity.NEUTRAL[lang] for t in ts]
        assert max(scorer.logits(texts)) < 0
    for group in (g for gs in toxicity.IDENTITY_GROUPS.values() for g in gs):
        scores = scorer.logits([f"w1 w2 {t} w3" for t in group])
        assert max(scores) - min(scores) < 0.5
    assert toxicity.swaps([b"the", b"woman"], toxicity._groups({"en": [["woman", "man"]]})) == [[b"the", b"man"]]
    assert toxicity.Scorer(plain).logits(["a muslim w1 w2"])[0] > max(scorer.logits(["a muslim w1 w2"]))


def test_fit_reaches_the_least_loss():
    """Against plain proximal gradient steps of a safe size on dense arrays."""
    r = np.random.default_rng(3)
    n, m = 6, 120
    x = r.random((m, n)) < 0.4
    y = (x @ r.normal(size=n) + r.normal(size=m) > 0.3).astype(float)
    rows = [(int(y[i]), np.flatnonzero(x[i]).tolist()) for i in range(m)]
    changes = [([0], [1]), ([2, 3], [4]), ([0], [1])]
    delta = np.array([[1, -1, 0, 0, 0, 0], [0, 0, 1, 1, -1, 0], [1, -1, 0, 0, 0, 0]], float)
    pos = y.sum()
    weight = np.where(y > 0, max(1.0, (m - pos) / pos) ** 0.5, 1.0)

    def loss(w, b):
        z = x @ w + b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + toxicity.L1 * np.abs(w).sum() + 5.0 / 2 * ((delta @ w) ** 2).sum())

    w, b = toxicity.fit(rows, changes, n, counterfactual=5.0, rounds=3000)
    pw, pb, step = np.zeros(n), 0.0, 0.005
    for _ in range(60_000):
        g = weight * (1 / (1 + np.exp(-(x @ pw + pb))) - y)
        pw = pw - step * (x.T @ g + 5.0 * delta.T @ (delta @ pw))
        pw, pb = np.sign(pw) * np.maximum(0, np.abs(pw) - step * toxicity.L1), pb - step * g.sum()
    assert abs(loss(w, b) - loss(pw, pb)) < 1e-4 * loss(pw, pb) and np.abs(w - pw).max() < 0.02 and abs(b - pb) < 0.02


def test_scores_equal_the_plain_sum(spark):
    docs, marks = marked(spark, seed=4)
    model = toxicity.train(docs, marks)
    texts = ["scum scum w1", "w2", "Scum! MUSLIM, scum", "", None, "w3 " * 200_000 + "scum", "a muslim woman"]
    rows = [(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(0, texts[0], 0.1, "y"), (None, texts[2], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string").repartition(3)

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        count = collections.Counter(f for w in words for f in ["=" + w, *("^" + w[:k] for k in toxicity.STARTS if len(w) > k)])
        every = set(count) | {"2" + f for f, n in count.items() if n > 1}
        z = model.bias + sum(model.weights.get(f.encode(), 0.0) for f in every)
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = sorted(((r.doc_id is None, r.doc_id, r.predicted), r.score) for r in toxicity.score(df, model).collect())
    want = sorted(((d is None, d, int(plain(t) >= 0.5)), plain(t)) for d, t, _, _ in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))
    kept = toxicity.keep_clean(df, model)
    assert kept.dtypes == df.dtypes and ordered(r[:2] for r in kept.collect()) == ordered((d, t) for d, t, _, _ in rows if plain(t) < 0.5)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = table(spark, D, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, D), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and all(before[k] == t for k, t in after.items())
        if name == "toxicity":
            held = common.F.pmod(common.F.crc32(common.F.col("doc_id").cast("string").cast("binary")), common.F.lit(5)) == 0
            scorer = toxicity.Scorer(toxicity.train(spark.createDataFrame(list(before.items()), "doc_id long, text string"), table(spark, D, "labels").where(~held)))
            assert set(after) == {k for k, z in zip(before, scorer.logits(list(before.values()))) if z < 0} != set(before)
        if name == "exact_dedup":
            last = {}
            for k, t in before.items():
                last[low(t)] = max(k, last.get(low(t), k))
            assert set(after) == set(last.values())
        if name == "near_dedup":
            assert ordered((k,) for k in after) == ordered((x[0],) for x in linked(list(before.items()), 5, 80) if x[3])
        if name == "decontamination":
            found = decontamination.contamination(spark.createDataFrame(list(before.items()), "doc_id long, text string"), table(spark, D, "benchmark"))
            assert set(after) == {r.doc_id for r in found.where("not contaminated").collect()}
        assert after
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_runs_and_leaves_only_its_result(spark, tmp_path):
    import corpus_pipeline

    since = common.mark(spark)
    out = corpus_pipeline.run(spark, D)
    assert sorted(out.columns) == sorted(c.split()[0] for c in packing.PIECES.split(", ")) and out.count() > 0
    from chunkwell.sources import session

    made = [p for p in session._scratch[spark.sparkContext.applicationId][since:] if p]
    assert [p for p in made if os.path.exists(p.removeprefix("file:"))] == [out.__dict__["_scratch"]]
    # nulls, repeated rows and ids, an odd column and an empty table through every stage
    rows = [(None, None, "en", "s", 0, {"a": 1}), (None, "", "en", "s", 0, None), (1, "one two three four five six seven", None, None, None, {}), (1, "one two three four five six seven", None, None, None, {}), (1, "other words", "en", "s", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row map<string,int>")
    for some, want in ((docs, {(None, True), (1, False)}), (docs.limit(0), set())):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialise(stage(spark, now, D), name)
            assert now.dtypes == docs.dtypes
        assert {(r.doc_id, not r.text) for r in now.collect()} == want
        assert corpus_pipeline.STAGES[-1][1](spark, now, D).select("doc_id").distinct().count() == len({d for d, _ in want})


def test_queries_against_sql(spark):
    import duckdb

    from chunkwell.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert len(QUERIES) == 10 and set(ORACLE) <= set(QUERIES)
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, D)
        r = c.execute(sql)
        at = [x[0] for x in r.description]
        assert sorted(at) == sorted(df.columns)
        assert ordered(df.select(*at).collect()) == ordered(r.fetchall())
