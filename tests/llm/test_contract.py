"""Names and types of the queries' columns, and a row for every document or page."""

import pytest

from chunkwell.llm.common import table
from chunkwell.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5": "page_id bigint, url string, text string, n_chars bigint",
    "op7": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op8": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns(spark, op):
    name = next(n for n in QUERIES if n.split("_")[0] == op)
    df = QUERIES[name](spark, D)
    want = [tuple(c.split()) for c in COLUMNS[op].split(", ")]
    assert df.dtypes[: len(want)] == want
    source, key = ("pages", "page_id") if op == "op5" else ("documents", "doc_id")
    ids = sorted(r[0] for r in table(spark, D, source).select(key).collect())
    got = [r[0] for r in df.select(key).collect()]
    assert sorted(set(got)) == ids if op == "op9" else sorted(got) == ids


def test_secrets_query(spark):
    d = "/root/testdata/sf0.01"
    df = QUERIES["op6_secrets"](spark, d)
    assert df.columns == ["doc_id", "start", "end", "value_sha256", "score", "secret"]
    planted = table(spark, d, "documents").where("text rlike '(?i)token = \"[0-9a-f]{40}'")
    assert {r.doc_id for r in df.where("secret").collect()} == {r.doc_id for r in planted.collect()} != set()
