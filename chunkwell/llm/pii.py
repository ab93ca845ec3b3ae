"""Personal data, by DataFrame functions only: regular expressions propose spans, checksums and number rules confirm
them, and words nearby adjust the score.

The patterns are written so that no match can take more than linear time: runs are possessive and begin where the run
begins, or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import around, blocks_of, stretch, with_matches

_LOCAL = "A-Za-z0-9._%+-"
# Characters of an IBAN by country, as its registry has them.
IBAN = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban() -> str:
    """Countries of one length together: two check digits, then groups of four and what is left over."""
    lengths = {n: "|".join(x[:2] for x in IBAN.split() if int(x[2:]) == n) for n in sorted({int(x[2:]) for x in IBAN.split()})}
    rest = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    return r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c})[0-9]{{2}}{rest(n)}" for n, c in lengths.items()) + r")(?![A-Za-z0-9])"


PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
# Words that make a kind likelier when they stand within NEAR code points.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
NEAR = 40
#: Scores of a span that its rule confirms, and what a context word adds. An added kind needs LEAST to be reported.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
BONUS, LEAST = 0.3, 0.5


def _mod97(value: Column) -> Column:
    s = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    digit = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(10, 15)
    return _mod97(value) if kind == "iban" else F.lit(True)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans: array<struct<start, at, end, kind, score>>, sorted by start, then by kind in PATTERNS' order.

    start and end count code points, end excluded. A null text counts as empty and has no spans. Spans of different
    kinds may overlap. Null and repeated doc_ids stay rows; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    gates = {"email": F.col("text").contains("@"), "ip": F.col("text").contains(".") & digit, "card": digit, "phone": F.col("text").contains("+"), "iban": digit, "ssn": F.col("text").contains("-") & digit}
    found = with_matches(rows, "text", PATTERNS, gates)
    found = found.withColumn("blocks", blocks_of("text", F.greatest(*(F.size(kind) for kind in PATTERNS)) > 0))
    for at, kind in enumerate(PATTERNS):
        sure = F.filter(kind, lambda x: _confirmed(kind, x["value"]))
        near = lambda x: F.lower(F.concat_ws(" ", *around("blocks", x["start"], x["end"], NEAR)))
        score = lambda x: F.lit(PRIOR[kind]) + F.when(near(x).rlike(rf"\b(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0)
        scored = F.transform(sure, lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("at"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score(x), F.lit(1.0)).alias("score")))
        found = found.withColumn(kind, scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST))
    return found.select("doc_id", "text", F.array_sort(F.concat(*PATTERNS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and spans (kind:start:end, comma-joined), counts of the added kinds
    and of all, and the spans' scores, comma-joined in their order."""
    scores = F.array_join(F.transform("spans", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores")
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), *(count(k) for k in PATTERNS if k not in BASE), F.size("spans").cast("long").alias("n_spans"), scores)


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with each stretch of spans replaced by the first one's kind in brackets."""
    merged = F.aggregate("spans", F.array().cast("array<struct<start:int, at:int, end:int, kind:string, score:double>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.get(acc, F.size(acc) - 1).withField("end", F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]))))).otherwise(F.concat(acc, F.array(x))))
    rows = found.withColumn("merged", merged).withColumn("blocks", blocks_of("text", F.size("merged") > 0))
    ends = lambda i: F.when(i == 0, 0).otherwise(F.get("merged", i - 1)["end"])
    kept = F.transform("merged", lambda x, i: F.concat(stretch("blocks", ends(i), x["start"] - ends(i)), F.lit("["), x["kind"], F.lit("]")))
    tail = F.when(F.size("merged") == 0, F.col("text")).otherwise(F.col("text").substr(F.get("merged", F.size("merged") - 1)["end"] + 1, F.char_length("text")))
    return rows.select("doc_id", F.concat(F.array_join(kept, ""), tail).alias("text"))
