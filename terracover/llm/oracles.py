"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from terracover.llm import pii

#: Patterns as SQL writes them, without look-behind; a filter on each candidate follows.
_CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"[0-9-]+",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1] END)) % 10 = 0"
_PLAIN = "replace(m, ' ', '')"
_MOD97 = f"CAST(list_reduce(list_prepend(0, list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: CAST(CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS INT))), lambda a, d: CASE WHEN d >= 10 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) AS INT) = 1"
_CONFIRMED = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS DOUBLE), 999) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD97}",
    "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
}


def _pii() -> str:
    ctes, parts = [], []
    for k, kind in enumerate(pii.KINDS):
        pattern = f"(?s)(.*?)({_CANDIDATES[kind]})"
        ctes.append(f"a_{kind} AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 1) AS gs, regexp_extract_all(coalesce(text, ''), '{pattern}', 2) AS ms FROM documents)")
        ctes.append(f"b_{kind} AS (SELECT doc_id, unnest(gs) AS g, unnest(ms) AS m, generate_subscripts(gs, 1) AS k FROM a_{kind})")
        ctes.append(f"c_{kind} AS (SELECT doc_id, g, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e FROM b_{kind})")
        score = f"least(1.0, {pii.SCORES[kind]} + CASE WHEN regexp_matches(lower(right(g, {pii.WINDOW})), '{pii.CONTEXT[kind]}') THEN {pii.CONTEXT_GAIN} ELSE 0 END)"
        least = "" if kind in pii.BASE else f" AND {score} >= {pii.ADDED_MIN}"
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {k} AS ord, e - length(m) AS s, e, {score} AS score FROM c_{kind} WHERE {_CONFIRMED[kind]}{least}")
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    item = "kind || ':' || s || ':' || e"
    return (
        f"WITH {', '.join(ctes)}, spans AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, "
        + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in pii.KINDS)
        + f", sha256(coalesce(string_agg({item}, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({item}, ',' ORDER BY s, ord), '') AS spans"
        + ", coalesce(string_agg(kind || ':' || s || ':' || printf('%.2f', score), ',' ORDER BY s, ord), '') AS scores FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"
    )


_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.n),
least AS (SELECT n, min(c) AS component_id FROM reach GROUP BY n)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least ON least.n = e.vec_id
"""

_PAGES = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (tot.n + 5 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN tot USING (lang, source) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(t.n) + 5 * any_value(v.v)) AS q
  FROM kept k JOIN c USING (lang, term) JOIN (SELECT lang, sum(n) AS n FROM tot GROUP BY ALL) t USING (lang) JOIN v USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_pii": _pii(), "op3_embed_dedup": _VECTORS, "op4_warc": _PAGES, "op12_divergence": _DIVERGENCE}
