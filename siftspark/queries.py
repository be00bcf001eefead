"""Registered queries of the engine over the given tables, and the SQL that answers each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import collections as C
from siftspark import oracle as O
from siftspark.functions.text import terms
from siftspark.operators import analytics
from siftspark.operators.facets import facet_counts
from siftspark.operators.search import matched_documents, page
from siftspark.operators.suggest import suggest
from siftspark.plans.request import resolve_search
from siftspark.plans.sorting import ordering
from siftspark.sources.ingest import compact, live_snapshot, without_deleted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _matched(name: str, collection: str, where: str = "true", **params) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = resolve_search(C.TABLES[collection][0], **params)
        return matched_documents(C.opened(spark, sf_dir, collection, request), request).select("doc_id", "text_match")

    _add(name, query, O.matched_sql(collection, where, **{k: v for k, v in params.items() if k not in ("filter", "sort")}))


def _browsed(name: str, collection: str, filter: str, where: str) -> None:
    """A filter alone needs no index."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = resolve_search(C.TABLES[collection][0], filter=filter)
        return C.documents(spark, sf_dir, collection).where(request.filter).select("doc_id")

    _add(name, query, f"WITH base AS ({O.BASE[collection]}) SELECT doc_id FROM base WHERE {where}")


def _paged(name: str, collection: str, order: str, where: str = "true", **params) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = resolve_search(C.TABLES[collection][0], **params)
        index = C.opened(spark, sf_dir, collection, request)
        shown = page(matched_documents(index, request), index, request)
        # At most a page of rows is ranked here.
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ordering(request.sort, index.schema))) + F.lit(request.offset)
        return shown.withColumn("rank", rank.cast("int")).select("doc_id", "text_match", "rank")

    _add(name, query, O.page_sql(collection, order, where, **{k: v for k, v in params.items() if k not in ("filter", "sort")}))


def _faceted(name: str, collection: str, fields: dict[str, str], where: str = "true", **params) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = resolve_search(C.TABLES[collection][0], facet=",".join(fields), **params)
        return facet_counts(matched_documents(C.opened(spark, sf_dir, collection, request), request), request.facets)

    _add(name, query, O.facets_sql(collection, fields, where, **{k: v for k, v in params.items() if k != "filter"}))


# Text and index

def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents(spark, sf_dir, "docs").select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))


def tokenize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents(spark, sf_dir, "pages").select("doc_id", F.posexplode(terms(F.col("html"))).alias("pos", "term"))


_add("tokenize", tokenize, f"WITH {O.index_sql('docs')} SELECT doc_id, pos, term FROM tok")
_add("tokenize_html", tokenize_html, f"WITH {O.index_sql('pages')} SELECT doc_id, pos, term FROM tok")
_add(
    "index_postings", lambda s, d: C.index(s, d, "docs").postings.select("field", "term", "doc_id", "tf", "len", F.array_join("positions", ",").alias("positions")),
    f"WITH {O.index_sql('docs')} SELECT field, term, doc_id, tf, len, array_to_string(ps, ',') AS positions FROM post JOIN lens USING (field, doc_id)",
)
_add("field_length", lambda s, d: C.index(s, d, "parts").postings.groupBy("field", "doc_id").agg(F.max("len").alias("len")), f"WITH {O.index_sql('parts')} SELECT field, doc_id, len FROM lens")
_add("field_stats", lambda s, d: C.index(s, d, "docs").stats, f"WITH {O.index_sql('docs')} SELECT field, docs, tokens FROM stats")
_add("term_df", lambda s, d: C.index(s, d, "docs").terms.select("field", "term", "df"), f"WITH {O.index_sql('docs')} SELECT field, term, df FROM dict")
_add(
    "dictionary_prefix", lambda s, d: C.index(s, d, "docs").terms.where(F.col("term").startswith("th")).select("term").distinct().orderBy("term").limit(128),
    f"WITH {O.index_sql('docs')} SELECT DISTINCT term FROM dict WHERE starts_with(term, 'th') ORDER BY term LIMIT 128",
)
_add(
    "dictionary_values", lambda s, d: C.documents(s, d, "docs").groupBy("source").agg(F.count("*").alias("count")),
    f"WITH base AS ({O.BASE['docs']}) SELECT source, count(*) AS count FROM base GROUP BY source",
)

# Matching and scoring

_plain = {"prefix": False, "typo_tolerance": False}
_matched("bm25_single", "docs", q="the", **_plain)
_matched("search_all", "docs", q="the of and", **_plain)
_matched("search_any", "docs", q="para the", match_mode="any", **_plain)
_matched("search_multi_field", "parts", q="small red", match_mode="any", **_plain)
_matched("search_one_field", "parts", q="small", query_by="title", **_plain)
_matched("search_repeated_word", "docs", q="the the", **_plain)
_matched("search_chat", "chat", q="the", **_plain)
_matched("search_unknown_word", "docs", q="qqqqzzzz", **_plain)
_matched("phrase", "docs", q='"of the"', **_plain)
_matched("phrase_and_word", "docs", q='and "of the"', match_mode="any", **_plain)
_matched("proximity", "docs", q="on the in of", **_plain)
_matched("prefix", "docs", q="thin", typo_tolerance=False)
_matched("prefix_two_words", "docs", q="the thon", typo_tolerance=False)
_matched("typo", "docs", q="thign", prefix=False)
_matched("typo_two_words", "parts", q="smlal red", match_mode="any")
_matched("popularity", "parts", q="hot gear", match_mode="any", **_plain)
_matched("match_all_documents", "docs", q="")
_matched("search_filtered", "docs", where="lang = 'en' AND n_chars > 1000", q="the", filter="lang:=en && n_chars:>1000", **_plain)
_matched("found", "docs", where="lang = 'fr'", q="la", filter="lang:fr", **_plain)
QUERIES["found"] = lambda s, d, q=QUERIES["found"]: q(s, d).agg(F.count("*").alias("found"))
ORACLE_SQL["found"] = f"SELECT count(*) AS found FROM ({ORACLE_SQL['found']})"

_matched("search_all_fields", "parts", q="red economy", **_plain)
_matched("phrase_and_other_field", "parts", q='"small ring" economy', **_plain)
_matched("search_han", "odd", q="r月d", query_by="title", **_plain)
_matched("phrase_han", "odd", q='"r月d"', query_by="title", **_plain)
_VALUES = " UNION ALL ".join(f"SELECT doc_id, {i} AS nth, regexp_extract_all(lower(strip_accents(names[{i}])), '[\\p{{L}}\\p{{N}}]+') AS w FROM base" for i in (1, 2, 3))
_add(
    "postings_of_many_values", lambda s, d: C.index(s, d, "odd").postings.where("field = 'names'").select("term", "doc_id", "tf", "len", F.array_join("positions", ",").alias("positions")),
    f"""WITH base AS ({O.BASE['odd']}), vals AS ({_VALUES}), starts AS (SELECT doc_id, w, coalesce(sum(len(w) + 100) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(len(w)) OVER (PARTITION BY doc_id) AS len FROM vals),
t AS (SELECT doc_id, len, low + unnest(range(len(w))) AS pos, unnest(w) AS term FROM starts) SELECT term, doc_id, count(*)::INT AS tf, any_value(len)::INT AS len, string_agg(pos::BIGINT, ',' ORDER BY pos) AS positions FROM t GROUP BY term, doc_id""",
)

# Filters

_browsed("filter_date", "odd", "made:>=2001-09-09T01:46:40Z", "made >= 1000000000000")

_browsed("filter_equal", "docs", "lang:=de", "lang = 'de'")
_browsed("filter_not_equal", "docs", "lang:!=de", "lang IS NOT NULL AND lang <> 'de'")
_browsed("filter_less", "parts", "price:<950.5", "price < 950.5")
_browsed("filter_at_most", "parts", "size:<=10", "size <= 10")
_browsed("filter_greater", "parts", "size:>40", "size > 40")
_browsed("filter_at_least", "parts", "price:>=960", "price >= 960")
_browsed("filter_range", "parts", "size:[10..20]", "size BETWEEN 10 AND 20")
_browsed("filter_in", "docs", "lang:=[en, fr]", "lang IN ('en', 'fr')")
_browsed("filter_not_in", "docs", "lang:!=[en, fr]", "lang IS NOT NULL AND lang NOT IN ('en', 'fr')")
_browsed("filter_and_or", "parts", "(size:<5 || size:>45) && big:=true", "(size < 5 OR size > 45) AND big")
_browsed("filter_precedence", "parts", "size:<5 || size:>45 && price:<940", "size < 5 OR (size > 45 AND price < 940)")
_browsed("filter_bool", "parts", "big:=false", "NOT big")
_browsed("filter_multi_equal", "parts", "steps:=3", "list_contains(steps, 3)")
_browsed("filter_multi_not_equal", "parts", "steps:!=3", "len(steps) > 0 AND NOT list_contains(steps, 3)")
_browsed("filter_multi_less", "parts", "steps:<1", "list_min(steps) < 1")
_browsed("filter_absent", "parts", "spare:!=3", "spare IS NOT NULL AND spare <> 3")

# Sorting and paging

_paged("page_relevance", "docs", "text_match DESC", q="the of", limit=50, **_plain)
_paged("page_second", "docs", "text_match DESC", q="the", limit=25, offset=25, **_plain)
_paged("page_worst_first", "docs", "text_match ASC", q="the", sort="_text_match:asc", limit=20, **_plain)
_paged("sort_field", "docs", "n_chars DESC NULLS LAST", q="", sort="n_chars:desc", limit=100)
_paged("sort_two_fields", "parts", "size ASC NULLS LAST, price DESC NULLS LAST", q="", sort="size:asc,price:desc", limit=100)
_paged("sort_nulls_last", "parts", "spare DESC NULLS LAST", where="size <= 4", q="", filter="size:<=4", sort="spare:desc", limit=250)
_paged("sort_array_least", "parts", "list_min(steps) DESC NULLS LAST", q="", sort="steps:desc", limit=100)
_paged("sort_score_then_field", "parts", "text_match DESC, price ASC NULLS LAST", q="small", sort="_text_match:desc,price:asc", limit=60, **_plain)

_paged("sort_date", "odd", "made DESC NULLS LAST", q="", sort="made:desc", limit=100)

# Facets

_bools = "[CASE WHEN big THEN '1' ELSE '0' END]"
_faceted("facet_keyword", "docs", {"lang": "[lang]", "source": "[source]"}, q="")
_faceted("facet_numeric", "parts", {"size": "[size::VARCHAR]", "big": _bools}, q="")
_faceted("facet_multi_valued", "parts", {"tags": "list_distinct(tags)", "steps": "list_transform(steps, lambda x: x::VARCHAR)"}, q="")
_faceted("facet_after_search", "docs", {"lang": "[lang]"}, where="n_chars > 2000", q="the", filter="n_chars:>2000", **_plain)

# Completion

def _suggested(name: str, collection: str, q: str, edits_at_most: int, limit: int = 50) -> None:
    budget = f"SELECT term, damerau_levenshtein(term, '{q}')::INT AS edits FROM known WHERE abs(length(term) - {len(q)}) <= {edits_at_most} AND damerau_levenshtein(term, '{q}') BETWEEN 1 AND {edits_at_most}"
    sql = f"""WITH {O.index_sql(collection)}, known AS (SELECT term, sum(df)::BIGINT AS count FROM dict GROUP BY term),
f AS (SELECT * FROM (SELECT term, 0 AS edits FROM known WHERE starts_with(term, '{q}') ORDER BY term LIMIT 1000) UNION ALL {budget})
SELECT term AS text, min(edits)::INT AS edits, any_value(count) AS count FROM f JOIN known USING (term) GROUP BY term ORDER BY 2, 3 DESC, 1 LIMIT {limit}"""
    _add(name, lambda s, d: suggest(C.index(s, d, collection), q, limit=limit), sql)


_suggested("suggest_prefix", "docs", "tha", 0)
_suggested("suggest_typo", "parts", "smlal", 1)

# Writes

def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: the user is the key, and some events delete."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "purchase").alias("deleted"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_snapshot(_writes(spark, sf_dir)).select("id", "seq", "value")


def delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return without_deleted(orders, _writes(spark, sf_dir).where("deleted"))


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _writes(spark, sf_dir).drop("deleted")
    half = [writes.where("seq % 2 = 0"), writes.where("seq % 2 = 1")]
    gone = C.documents(spark, sf_dir, "parts").where("big").select(F.col("doc_id").alias("id"))
    return compact(half, gone, order="seq").select("id", "seq", "value")


_LATEST = "SELECT user_id AS id, event_id AS seq, value, event_type = 'purchase' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
_add("upsert_latest", upsert_latest, f"SELECT id, seq, value FROM ({_LATEST}) WHERE NOT deleted")
_add("delete_tombstone", delete_tombstone, "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
_add("compact", compacted, f"SELECT id, seq, value FROM ({_LATEST}) WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")

# Analytics

_STATS = f"""WITH log AS ({O.LOG}), q AS (
SELECT collection, query, count(*) AS count, count(*) FILTER (found = 0) AS zero_result_count, arg_max(found, (ts, found)) AS last_result_count, sum(latency_us) / count(*) / 1000 AS avg_latency_ms, max(ts) AS last_seen
FROM log GROUP BY collection, query)"""
_COLS = "collection, query, count, zero_result_count, last_result_count, avg_latency_ms, last_seen"
_BUCKETS = f"WITH log AS ({O.LOG}), b AS (SELECT least(greatest(length(bin(latency_us)) - 1, 0), 31)::INT AS bucket, latency_us FROM log)"
_add("query_stats", lambda s, d: analytics.query_stats(C.query_log(s, d)), f"{_STATS} SELECT {_COLS} FROM q")
_add("top_queries", lambda s, d: analytics.top_queries(C.query_log(s, d)), f"{_STATS} SELECT {_COLS} FROM q ORDER BY count DESC, last_seen DESC, query, collection LIMIT 20")
_add("zero_results", lambda s, d: analytics.zero_result_queries(C.query_log(s, d)), f"{_STATS} SELECT {_COLS} FROM q WHERE zero_result_count > 0 ORDER BY zero_result_count DESC, last_seen DESC, query, collection LIMIT 20")
_add("latency_hist", lambda s, d: analytics.latency_histogram(C.query_log(s, d)), f"{_BUCKETS} SELECT bucket, count(*) AS count FROM b GROUP BY bucket")
_add(
    "latency_percentiles", lambda s, d: analytics.latency(C.query_log(s, d)),
    f"""{_BUCKETS}, t AS (SELECT count(*) AS total, max(latency_us) AS most FROM b), r AS (SELECT bucket, sum(count(*)) OVER (ORDER BY bucket) AS upto FROM b GROUP BY bucket)
SELECT percentile::INT AS percentile, least(2 ** (min(bucket) + 1), max(greatest(most, 1)))::BIGINT AS latency_us FROM r, t, (VALUES (50), (95), (99)) p(percentile) WHERE upto * 100 >= total * percentile GROUP BY percentile""",
)
_add(
    "throughput", lambda s, d: analytics.throughput(C.query_log(s, d)),
    f"WITH log AS ({O.LOG}), t AS (SELECT count(*) AS total, (max(ts) - min(ts)) / 1000 AS seconds FROM log) SELECT total, seconds, CASE WHEN seconds > 0 THEN total / seconds ELSE 0 END AS per_second FROM t",
)
