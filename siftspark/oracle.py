"""DuckDB SQL for what the engine computes, written from the definitions."""

from __future__ import annotations

from siftspark.collections import TABLES
from siftspark.plans.request import SearchRequest, resolve_search

BASE = {
    "docs": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "parts": (
        "SELECT p_partkey AS doc_id, p_name AS title, p_type AS kind, p_brand AS brand, p_size::BIGINT AS size, p_retailprice AS price, p_size::BIGINT AS popularity, p_size > 25 AS big, "
        "string_split(p_name, ' ') AS tags, [p_size::BIGINT, p_size::BIGINT % 5] AS steps, CASE WHEN p_size % 3 = 0 THEN p_size::BIGINT END AS spare FROM part"
    ),
    "chat": "SELECT conv_id * 1000 + turn AS doc_id, text, role, turn FROM conversations",
    "pages": "SELECT page_id AS doc_id, html FROM pages",
    "odd": "SELECT p_partkey AS doc_id, translate(p_name, 'aeiou', '日月水火木') AS title, [p_name, p_type, p_brand] AS names, p_partkey * 86400000000 % 1700000000000 AS made FROM part",
}
LOG = (
    "SELECT 'c' || (user_id % 3) AS collection, event_type || ' ' || (user_id % 17) AS query, CASE WHEN value < 10 THEN 0 ELSE floor(value) END::BIGINT AS found, "
    "round(abs(value) * 1000)::BIGINT AS latency_us, epoch_us(ts) // 1000 AS ts FROM events"
)


def index_sql(name: str) -> str:
    """Common tables base, tok, post, lens, stats and dict of a collection."""
    fields = [f.name for f in TABLES[name][0].searchable if not f.multi]
    # Han characters are tokens by themselves; blanks around them make them so.
    each = " UNION ALL ".join(
        f"SELECT '{f}' AS field, doc_id, regexp_extract_all(regexp_replace(lower(strip_accents({f})), '([\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS w FROM base"
        for f in fields
    )
    return f"""base AS ({BASE[name]}),
tok AS MATERIALIZED (SELECT field, doc_id, (unnest(range(len(w))))::INT AS pos, substr(unnest(w), 1, 64) AS term FROM ({each})),
post AS MATERIALIZED (SELECT field, term, doc_id, count(*)::INT AS tf, list(pos ORDER BY pos) AS ps FROM tok GROUP BY field, term, doc_id),
lens AS (SELECT field, doc_id, sum(tf)::INT AS len FROM post GROUP BY field, doc_id),
stats AS (SELECT field, count(*) AS docs, sum(len)::BIGINT AS tokens FROM lens GROUP BY field),
dict AS MATERIALIZED (SELECT field, term, count(*) AS df FROM post GROUP BY field, term)"""


def _expansion_sql(request: SearchRequest, name: str) -> str:
    schema, words = TABLES[name][0], request.query.tokens
    parts = [f"SELECT {i} AS token, '{w}' AS term, 0 AS edits" for i, w in enumerate(words)]
    last = len(words) - 1
    if request.prefix and not request.query.in_phrase(last):
        parts.append(f"SELECT {last}, term, 0 FROM (SELECT DISTINCT term FROM dict WHERE starts_with(term, '{words[last]}') ORDER BY term LIMIT 128)")
    for i, w in enumerate(words):
        most = schema.typo.budget(len(w))
        if request.typos and most and not request.query.in_phrase(i):
            near = f"SELECT term, damerau_levenshtein(term, '{w}') AS edits FROM (SELECT DISTINCT term FROM dict) WHERE abs(length(term) - {len(w)}) <= {most} AND damerau_levenshtein(term, '{w}') <= {most} ORDER BY edits, term LIMIT 128"
            parts.append(f"SELECT {i}, term, edits::INT FROM ({near}) WHERE edits > 0")
    return "SELECT token, term, min(edits) AS edits FROM (" + " UNION ALL ".join(parts) + ") GROUP BY token, term"


def matches_sql(name: str, request: SearchRequest) -> str:
    """The common tables up to ``scored`` (doc_id, text_match)."""
    schema, words, phrases = TABLES[name][0], request.query.tokens, request.query.phrases
    by = request.query_by
    names = ", ".join(f"'{f.name}'" for f in by)
    boost = "CASE field " + " ".join(f"WHEN '{f.name}' THEN {float(f.weight)}" for f in by) + " END"
    order = "CASE field " + " ".join(f"WHEN '{f.name}' THEN {i}" for i, f in enumerate(by)) + " END"
    allowed = sum(schema.typo.budget(len(w)) for w in words) if request.typos else 0
    n = len(words)
    nexts = ", ".join(f"min(CASE WHEN token = {k} THEN pos END) OVER (PARTITION BY doc_id, field ORDER BY pos RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n{k}" for k in range(n))
    present = " + ".join(f"(n{k} IS NOT NULL)::INT" for k in range(n))
    spans = f"""points AS (SELECT doc_id, field, token, unnest(ps) AS pos FROM bt), reach AS (SELECT doc_id, field, pos, {nexts} FROM points),
span AS (SELECT r.doc_id, r.field, min(CASE WHEN {present} = b.n THEN {"greatest(" + ", ".join(f"n{k}" for k in range(n)) + ")" if n > 1 else "n0"} - r.pos END) AS s FROM reach r JOIN bf b USING (doc_id, field) GROUP BY r.doc_id, r.field)"""
    gates = [f"SELECT doc_id FROM bt GROUP BY doc_id HAVING count(DISTINCT token) = {n}"] if request.match_all else []
    for a, b in phrases:
        joins = " ".join(f"JOIN points p{k} ON p{k}.doc_id = p{a}.doc_id AND p{k}.field = p{a}.field AND p{k}.token = {k} AND p{k}.pos = p{a}.pos + {k - a}" for k in range(a + 1, b + 1))
        gates.append(f"SELECT DISTINCT p{a}.doc_id FROM points p{a} {joins} WHERE p{a}.token = {a}")
    gate = " AND ".join(f"doc_id IN ({g})" for g in gates) or "true"
    popular = "coalesce(popularity / (popularity + 100.0), 0)" if schema.field("popularity") else "0.0"
    typo = "1.0" if allowed == 0 else f"1.0 - least(used / {float(allowed)}, 1.0)"
    near = f"(CASE WHEN n <= 1 OR s = 0 THEN 1.0 ELSE least(1.0, (n - 1) / s) END) * (CASE WHEN n < {n} THEN n / {float(n)} ELSE 1.0 END)"
    return f"""WITH {index_sql(name)},
cand AS ({_expansion_sql(request, name)}),
hit AS (
  SELECT p.doc_id, p.field, c.token, c.edits, p.ps,
         ln(1 + (s.docs - least(d.df, s.docs) + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / (s.tokens / s.docs))) AS contrib
  FROM post p JOIN cand c USING (term) JOIN dict d USING (field, term) JOIN lens l USING (field, doc_id) JOIN stats s USING (field) WHERE field IN ({names})),
bt AS MATERIALIZED (SELECT doc_id, field, token, max(contrib) AS contrib, min(edits) AS edits, list_sort(list_distinct(flatten(list(ps)))) AS ps FROM hit GROUP BY doc_id, field, token),
bf AS (SELECT doc_id, field, sum(contrib) AS bm25, sum(edits) AS used, count(*) AS n, {boost} AS boost, {order} AS ord FROM bt GROUP BY doc_id, field),
{spans},
best AS (SELECT * FROM bf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bm25 * boost DESC, ord) = 1),
scored AS (
  SELECT doc_id, round(1000.0 * (0.45 * (bm25 / (bm25 + 10.0)) + 0.25 * least(boost / {float(schema.max_boost)}, 1.0) + 0.15 * {near} + 0.10 * ({typo}) + 0.05 * {popular}), 4) AS text_match
  FROM best JOIN span USING (doc_id, field) JOIN base USING (doc_id) WHERE {gate})"""


def matched_sql(name: str, where: str = "true", **params) -> str:
    """(doc_id, text_match) of all matches."""
    request = resolve_search(TABLES[name][0], **params)
    if not request.query.tokens:
        return f"WITH base AS ({BASE[name]}) SELECT doc_id, 0.0::DOUBLE AS text_match FROM base WHERE {where}"
    return f"{matches_sql(name, request)} SELECT doc_id, text_match FROM scored JOIN base USING (doc_id) WHERE {where}"


def page_sql(name: str, order: str, where: str = "true", **params) -> str:
    """(doc_id, text_match, rank) of the page."""
    request = resolve_search(TABLES[name][0], **params)
    source = f"{matches_sql(name, request)}, m AS (SELECT * FROM scored JOIN base USING (doc_id) WHERE {where})" if request.query.tokens else f"WITH base AS ({BASE[name]}), m AS (SELECT *, 0.0::DOUBLE AS text_match FROM base WHERE {where})"
    return f"{source} SELECT doc_id, text_match, (row_number() OVER (ORDER BY {order}, doc_id))::INT AS rank FROM m QUALIFY rank > {request.offset} AND rank <= {request.offset + request.limit}"


def facets_sql(name: str, fields: dict[str, str], where: str = "true", **params) -> str:
    """(field, value, count); ``fields`` gives the SQL list of each field's values as text."""
    request = resolve_search(TABLES[name][0], **params)
    source = f"{matches_sql(name, request)}, m AS (SELECT * FROM scored JOIN base USING (doc_id) WHERE {where})" if request.query.tokens else f"WITH base AS ({BASE[name]}), m AS (SELECT * FROM base WHERE {where})"
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, unnest({sql}) AS value FROM m" for f, sql in fields.items())
    return f"""{source}, v AS ({each}), c AS (SELECT field, value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY field, value)
SELECT field, value, count FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, value) <= 100"""
