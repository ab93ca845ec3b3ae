"""Secret scans, by DataFrame functions only: patterns propose candidates, a random forest removes false positives.

The forest is fitted on labelled findings and then written out as CASE expressions, so scoring stays inside the scan.
Features of a candidate: its length, alphabet, entropy, changes of character class, share of common letter pairs,
coverage by dictionary words, the path it stands in, and the words beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import around, blocks_of, with_matches

# Names after which a value is read.
KEYS = "password|passwd|passphrase|pwd|secret|api_?key|apikey|access_?key|private_?key|token|credentials?"
#: Tokens of 16 characters or more with a digit, and values of 8 or more after a telling key; whole, however long.
PATTERNS = {
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+",
    "value": rf"(?i)(?<=(?:{KEYS})[\"']?\x20?[=:]\x20?[\"']?)[^\s\"'<>,;=:]{{8,}}+",
}
# Words that cover ordinary identifiers; words beside secrets and beside harmless values; paths of examples.
DICTIONARY = "example|sample|test|dummy|placeholder|changeme|password|secret|token|value|name|user|admin|default|config|index|page|image|file|data|version|build|release|http|https|www|com|html|class|function|return|null|none|true|false|your|here|this|that|with|from|the|and|key|id|number|date|time|path|home|local|server|client|system|replace|insert|string|xxxx|0000|1234|process|env"
NEAR_SECRET = "password|passwd|pwd|passphrase|secret|token|api|key|auth|bearer|credential|private|access"
NEAR_HARMLESS = "sha|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|version|order|isbn|doi|example|sample|dummy|fake"
EXAMPLES = "test|example|sample|fixture|mock|doc|readme|tutorial"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
NEAR = 40
FEATURES = ["length", "digits", "uppers", "symbols", "entropy", "changes", "pairs", "covered", "longest", "hexadecimal", "quoted", "assigned", "near_secret", "near_harmless", "example_path", "url"]
#: Of the forest; the share of votes from which a candidate is a secret; labelled findings it reads at most.
TREES, DEPTH, LEAST, SAMPLE = 15, 8, 0.5, 20_000


def features(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds FEATURES for columns value, before, after (up to NEAR code points on either side) and a path column."""
    v, n = F.col("value"), F.greatest(F.char_length("value"), F.lit(1))
    share = lambda pattern: F.char_length(F.regexp_replace(v, pattern, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "B"), "[^0aB]", "_")
    runs = F.regexp_replace(kinds, r"(.)\1*+", "$1")
    letters = F.regexp_replace(F.lower(v), "[^a-z]", "")
    df = df.withColumn("_chars", F.filter(F.split(v, ""), lambda c: c != "")).withColumn("_low", F.lower(v)).withColumn("_left", F.lower("before")).withColumn("_right", F.lower("after"))
    count = lambda c: n - F.char_length(F.replace(v, c, F.lit("")))
    entropy = F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda s, c: s - (count(c) / n) * F.log2(count(c) / n))
    words = F.regexp_extract_all(F.lower(v), F.lit("[a-z]+"), F.lit(0))
    made = {
        "length": F.least(n, F.lit(128)).cast("double"),
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "symbols": share("[A-Za-z0-9]"),
        "entropy": entropy,
        "changes": (F.char_length(runs) - 1) / n,
        "pairs": 1 - F.char_length(F.regexp_replace(letters, f"(?:{PAIRS})", "")) / F.greatest(F.char_length(letters), F.lit(1)),
        "covered": 1 - F.char_length(F.regexp_replace(F.col("_low"), f"(?:{DICTIONARY})", "")) / n,
        "longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.char_length(w))), F.lit(0)) / n,
        "hexadecimal": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "quoted": F.col("before").rlike("[\"']$").cast("double"),
        "assigned": F.col("before").rlike("[=:]\\s?[\"']?$").cast("double"),
        "near_secret": F.col("_left").rlike(f"(?:{NEAR_SECRET})[a-z_]*[\\s\"'=:]*$").cast("double") + F.col("_left").rlike(f"(?:{NEAR_SECRET})").cast("double"),
        "near_harmless": F.col("_left").rlike(f"(?:^|[^a-z])(?:{NEAR_HARMLESS})[a-z0-9_]*[\\s\"'=:#-]*$").cast("double") + F.col("_right").rlike(f"^[\"'\\s]*(?:{NEAR_HARMLESS})\\b").cast("double"),
        "example_path": F.coalesce(F.lower(path).rlike(f"(?:{EXAMPLES})") if path else F.lit(False), F.lit(False)).cast("double"),
        "url": (F.col("_left").rlike(r"(?:https?:|www\.)\S*$") | v.contains("//")).cast("double"),
    }
    return df.withColumns({k: F.coalesce(x.cast("double"), F.lit(0.0)) for k, x in made.items()}).drop("_chars", "_low", "_left", "_right")


# What labelled findings are made of. Text before a value, by kind; paths of code and settings, and of
# examples; words of passwords people choose, and of harmless names.
BEFORE = {
    "telling": ['token = "', "api_key: '", "SECRET=", 'password = "', "access_token: ", "DB_PASSWORD=", "pwd: ", 'private_key = "', '"secret": "', "export API_KEY=", "client_secret='", "passwd="],
    "harmless": ["commit ", 'sha1 = "', "checksum: ", "uuid ", 'etag: "', "revision ", "digest = ", "md5:", "sha256sum ", 'integrity="'],
    "plain": ["see ", 'id = "', "name: ", "the ", "with ", "as ", 'value="', "ref ", "(", ""],
    "link": ["https://cdn.host.io/", 'src="http://host.io/a/', "www.host.io/x/", "https://host.io/get?f="],
}
PATHS = {"code": ["src/main/app.py", "config/production.env", "deploy/values.yaml", "lib/client.js", "infra/vars.tf", "notes/meeting.txt"], "example": ["tests/test_login.py", "examples/basic/main.go", "docs/setup.md", "README.md", "spec/fixtures/user.json", "samples/demo.env"]}
CHOSEN = "hunter|dragon|monkey|sunshine|shadow|falcon|winter|orange|silver|purple|thunder|rocket".split("|")
NAMES = "release|example|index|chapter|building|nightly|configuration|image|section|report|invoice|customer".split("|")


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Findings with labels, made by rule: value, before, after, path, label. The operator takes any others instead.

    What the value is, what stands before it, where it is, its length and the words around are drawn independently.
    Random text after a telling key and a chosen password there are secrets, keys with a known beginning anywhere are,
    all but (nearly always) in paths of examples; so is no random text after words of checksums, in links or alone,
    and no placeholder, name, date, number or file wherever it stands.
    """
    ids = spark.range(n)
    drawn = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    one = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), drawn(salt, len(xs)) + 1)
    h = F.concat(*(F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 256) for c in "abcd"))
    mixed = F.concat(*(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 256))), "[+/=]", "x") for c in "efgh"))
    length = F.element_at(F.array(*map(F.lit, [16, 20, 24, 32, 32, 40, 40, 40, 64, 64, 96, 128, 160])), drawn("n", 13) + 1)
    number, word, name, name2 = drawn("d", 9000).cast("string"), one("w", CHOSEN), one("x", NAMES), one("y", NAMES)
    random = [F.left(h, length), F.upper(F.left(h, length)), F.left(mixed, length), F.left(mixed, F.lit(12)), F.left(mixed, length + 3)]
    chosen = [F.concat(word, number), F.concat(F.initcap(word), F.lit("!"), number), F.concat(word, F.lit("_"), one("z", CHOSEN), number), F.concat(F.translate(word, "aeo", "430"), F.lit("$"), number, F.lit("x")), F.concat(word, drawn("g", 10).cast("string"), name2), F.concat(word, F.lit("-"), one("z", CHOSEN), F.lit("-"), drawn("g", 90).cast("string"))]
    known = [F.concat(F.lit("AKIA"), F.upper(F.left(mixed, F.lit(16)))), F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), F.concat(F.lit("sk-"), F.left(mixed, F.lit(40))), F.concat(F.lit("xoxb-"), F.conv(F.left(h, F.lit(10)), 16, 10), F.lit("-"), F.left(mixed, F.lit(24))), F.concat(F.lit("AIza"), F.left(mixed, F.lit(35)))]
    harmless = [
        F.concat(name, F.lit("_"), name2, F.lit("_"), number), F.concat(F.lit("your_"), name, F.lit("_token_here_1")), F.rpad(one("r", ["x", "0", "1", "a"]), 24, "x0"), F.concat(name, F.lit("-2024-01-"), name2),
        F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12)), F.conv(F.left(h, F.lit(14)), 16, 10),
        F.concat(F.lit("img/"), name, F.lit("/0"), number, F.lit("_large")), F.concat(F.lit("changeme"), number), F.concat(F.lit("example_"), name, F.lit("_value_1")), F.concat(F.lit("2024-01-15T10-30-"), number),
        F.concat(F.lit("${"), F.upper(name), F.lit("_PASSWORD}")), F.concat(F.lit("process/env/"), F.upper(name2), F.lit("_KEY1")), F.concat(name, F.lit("//"), name2, F.lit("/"), number), F.concat(F.lit("test_password_"), number), F.concat(F.lit("REPLACE_WITH_"), F.upper(name), F.lit("_1")),
    ]
    pick = lambda salt, xs: F.element_at(F.array(*xs), drawn(salt, len(xs)) + 1)
    kind, place, where = drawn("kind", 14), drawn("place", 8), drawn("where", 5)
    telling, example = place < 4, where < 2
    # of the kinds, 0 to 3 are random text, 4 and 5 chosen passwords, 6 to 8 known beginnings, the rest harmless
    value = F.when(kind < 4, pick("v", random)).when(kind < 6, pick("c", chosen)).when(kind < 9, pick("k", known)).otherwise(pick("o", harmless))
    before = F.when(telling, one("t", BEFORE["telling"])).when(place == 4, one("h", BEFORE["harmless"])).when(place == 7, one("l", BEFORE["link"])).otherwise(one("p", BEFORE["plain"]))
    before = F.when((kind.isin(4, 5)) & ~telling, one("t", BEFORE["telling"])).otherwise(before)
    secret = (kind.isin(4, 5) | ((kind < 4) & telling) | (kind.between(6, 8) & (place != 7))) & (~example | (drawn("e", 20) == 0))
    path = F.when(example, one("q", PATHS["example"])).when(where == 2, F.lit(None)).otherwise(one("q", PATHS["code"]))
    around = F.concat(one("u", ["", "some words before ", "x = 1; ", "the order of ", "auth and access: ", "2024-01-02 INFO "]), before)
    after = one("s", ['" and after', "'\n", "", " more words", '", "b": 2', ")", "\nversion: 3"])
    return ids.select(value.alias("value"), around.alias("before"), after.alias("after"), path.alias("path"), secret.cast("double").alias("label"))


def train(findings: DataFrame, sample: int = SAMPLE, seed: int = 7) -> list[dict]:
    """Trees as nested dicts from labelled findings (value, before, after, path, label): a sample of bounded size."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = findings.count()
    some = findings.where(F.pmod(F.xxhash64("value", "before"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, n)))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(some, "path")).select("x", "label").repartition(4).cache()
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)
    rows.unpersist()

    def node(j) -> dict:
        if j.subtreeDepth() == 0:
            stats = list(j.impurityStats().stats())
            return {"p": stats[1] / max(1e-9, sum(stats))}
        return {"f": j.split().featureIndex(), "t": j.split().threshold(), "l": node(j.leftChild()), "r": node(j.rightChild())}

    return [node(t._java_obj.rootNode()) for t in model.trees]


def vote(trees: list[dict]) -> Column:
    """The forest's mean share of secrets, as an expression over FEATURES.

    The trees read the fields of one struct: a condition on the score that the optimizer moves down takes each
    feature's expression along once, and not once for each place in a tree.
    """

    def of(n: dict) -> str:
        return f"{n['p']:.6f}D" if "p" in n else f"IF(x.{FEATURES[n['f']]} <= {n['t']!r}D, {of(n['l'])}, {of(n['r'])})"

    fields = ", ".join(f"'{f}', {f}" for f in FEATURES)
    return F.expr(f"get(transform(array(named_struct({fields})), x -> ({' + '.join(map(of, trees))}) / {len(trees)}), 0)")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, end, value, before, after, path: one row a candidate; a value that begins where a token does is that token.

    A value follows a sign that no token holds, so it begins inside a token only where the token begins.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"))
    key = F.lower(F.col("text")).rlike(KEYS)
    found = with_matches(rows, "text", PATTERNS, {"token": F.col("text").rlike("[0-9]"), "value": key})
    kinds = [F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("at"), x["end"].alias("end"), x["value"].alias("value"))) for at, name in enumerate(PATTERNS)]
    found = found.withColumn("blocks", blocks_of("text", F.size("token") + F.size("value") > 0)).withColumn("all", F.array_sort(F.concat(*kinds)))
    once = F.filter("all", lambda x, i: (i == 0) | (x["start"] != F.get("all", F.greatest(i - 1, F.lit(0)))["start"]))
    found = found.select("doc_id", "path", "blocks", once.alias("once"))
    beside = lambda x: [c.alias(n) for c, n in zip(around("blocks", x["start"], x["end"], NEAR), ("before", "after"))]
    each = found.select("doc_id", "path", F.inline(F.transform("once", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), *beside(x)))))
    return each.select("doc_id", "start", "end", "value", "before", "after", "path")


def scan(docs: DataFrame, trees: list[dict], path: str | None = None) -> DataFrame:
    """One row per candidate of (doc_id, text): doc_id, start, end, value_sha256, score, secret.

    start and end count code points, end excluded; the value itself is not given on. A null text counts as empty;
    texts without candidates give no rows; null doc_ids are kept; repeated rows give their findings each; other
    columns than path are ignored.
    """
    scored = features(candidates(docs, path), "path").withColumn("score", F.round(vote(trees), 6))
    return scored.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= LEAST).alias("secret"))
