"""DuckDB SQL for the personal data of `documents`: the contract's expressions as they stand, checked in plain list terms.

RE2 has no look-around. A number of the `ssn` form is therefore a whole run of digits and hyphens, and an IBAN is looked
for from every place that no letter or digit precedes.
"""

from __future__ import annotations

from .pii import BASE, BONUS, CONTEXT, IBAN, LEAST, NEAR, PATTERNS, PRIOR

#: What matches are taken of; iban and ssn have ways of their own.
_EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"[0-9-]+",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_DOUBLED = f"list_sum(list_transform(list_transform(string_split(reverse({_DIGITS}), ''), lambda x: CAST(x AS INT)), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END))"
_NUMBER = "array_to_string(list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
_RULES = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INT) > 255)) = 0",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_DOUBLED} % 10 = 0 ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"list_reduce(list_transform(string_split({_NUMBER}, ''), lambda x: CAST(x AS INT)), lambda r, x: (10 * r + x) % 97, 0) = 1",
    "ssn": "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND substr(v, 5, 2) <> '00' AND right(v, 4) <> '0000'",
}


def _matches(kind: str) -> str:
    """doc_id, t, k, s, v: a row for each match, s code points after the text's beginning."""
    if kind != "iban":
        e = _EXPRESSIONS[kind]
        return f"""
            SELECT doc_id, row, t, '{kind}' AS k, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, m[i] AS v
            FROM (SELECT doc_id, row, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, row, t, regexp_extract_all(t, '{e}') AS m, string_split_regex(t, '{e}') AS p FROM d))"""
    lengths = {int(x[2:]) for x in IBAN.split()}
    form = "|".join(f"(?:{'|'.join(x[:2] for x in IBAN.split() if int(x[2:]) == n)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in sorted(lengths))
    begins = f"regexp_matches(substr(t, i, 50), '^(?:{form})(?:[^A-Za-z0-9]|$)') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[A-Za-z0-9]'))"
    return f"""
            SELECT doc_id, row, t, 'iban' AS k, f.s, f.v FROM (
                SELECT doc_id, row, t, unnest(list_reduce(list_transform(list_filter(range(1, length(t) + 1), lambda i: {begins}), lambda i: [{{'s': i - 1, 'v': regexp_extract(substr(t, i, 50), '^(?:{form})')}}]),
                    lambda acc, x: CASE WHEN len(acc) = 0 OR acc[len(acc)].s + length(acc[len(acc)].v) <= x[1].s THEN list_concat(acc, x) ELSE acc END, CAST([] AS STRUCT(s BIGINT, v VARCHAR)[]))) AS f
                FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}'))"""


def sql() -> str:
    """The rows of op4_pii."""
    order = "CASE k " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PATTERNS)) + " END"
    rule = "CASE k " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in _RULES.items()) + " END"
    prior = "CASE k " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in PRIOR.items()) + " END"
    words = "CASE k " + " ".join(f"WHEN '{k}' THEN regexp_matches(near, '(?:^|[^\\pL\\p{{Nd}}_])(?:{w})')" for k, w in CONTEXT.items()) + " END"
    base = "(" + ", ".join(f"'{k}'" for k in BASE) + ")"
    count = lambda k: f"count(*) FILTER (k = '{k}') AS n_{k}"
    shown = "k || ':' || s || ':' || e, ',' ORDER BY s, o"
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
        found AS ({' UNION ALL '.join(map(_matches, PATTERNS))}),
        sure AS (
            SELECT doc_id, row, k, {order} AS o, s, s + length(v) AS e, lower(substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || ' ' || substr(t, s + length(v) + 1, {NEAR})) AS near
            FROM found WHERE {rule}),
        scored AS (SELECT *, least({prior} + CASE WHEN {words} THEN {BONUS} ELSE 0 END, 1.0) AS score FROM sure),
        told AS (
            SELECT row, {', '.join(map(count, PATTERNS))}, count(*) AS n_spans, string_agg({shown}) FILTER (k IN {base}) AS base, string_agg({shown}) AS spans, string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY s, o) AS scores
            FROM scored WHERE k IN {base} OR score >= {LEAST} GROUP BY row)
        SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
        FROM d LEFT JOIN told ON told.row = d.row"""
