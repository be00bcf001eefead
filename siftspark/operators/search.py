"""Searching: expanding words, matching documents, scoring, and the page that is shown."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions import scoring
from siftspark.functions.fuzzy import near_terms
from siftspark.operators.index import Index, bucket_of
from siftspark.plans.request import SearchRequest
from siftspark.plans.sorting import ordering

EXPANSION = 128
_MASK_BITS = 62


def expansions(index: Index, request: SearchRequest) -> DataFrame:
    """(token, term, edits): what each word of the query may match, by the dictionary.

    A word stands for itself; the last one, outside a phrase, for the first ``EXPANSION`` words that
    it begins; and every word outside a phrase for the nearest within its typo budget, of which the
    cap counts the word itself too.
    """
    words = request.query.tokens
    spark = index.terms.sparkSession
    parts = [spark.createDataFrame([(i, w, 0) for i, w in enumerate(words)], "token int, term string, edits int")]
    known = index.terms.select("term").distinct()
    last = len(words) - 1
    if request.prefix and not request.query.in_phrase(last):
        begun = known.where(F.col("term").startswith(words[last])).orderBy("term").limit(EXPANSION)
        parts.append(begun.select(F.lit(last).alias("token"), "term", F.lit(0).alias("edits")))
    for i, word in enumerate(words):
        most = index.schema.typo.budget(len(word))
        if request.typos and most and not request.query.in_phrase(i):
            near = near_terms(known, word, most).orderBy("edits", "term").limit(EXPANSION).where("edits > 0")
            parts.append(near.select(F.lit(i).alias("token"), "term", "edits"))
    return reduce(DataFrame.union, parts).groupBy("token", "term").agg(F.min("edits").alias("edits"))


def known_expansions(index: Index, request: SearchRequest) -> list[tuple[int, str, int]]:
    """``expansions`` on the driver: at most 2 * ``EXPANSION`` + 1 rows a word.

    The terms must be known when the index is read, so that only theirs is read. Words that stand for
    themselves alone take no job.
    """
    words = request.query.tokens
    open_ = [i for i, w in enumerate(words) if not request.query.in_phrase(i) and (request.typos and index.schema.typo.budget(len(w)) or request.prefix and i == len(words) - 1)]
    return [tuple(r) for r in expansions(index, request).collect()] if open_ else [(i, w, 0) for i, w in enumerate(words)]


def candidates(index: Index, request: SearchRequest) -> tuple[DataFrame, list[str]]:
    """(token, field, term, edits, idf, mean) of the expansions that occur in a queried field; and their terms."""
    names = [f.name for f in request.query_by]
    known = known_expansions(index, request)
    listed = sorted({term for _, term, _ in known})
    expanded = index.terms.sparkSession.createDataFrame(known, "token int, term string, edits int")
    stats = index.stats.select(F.col("field").alias("_f"), "docs", (F.col("tokens") / F.col("docs")).alias("mean"))
    found = index.terms.where(F.col("field").isin(names) & F.col("term").isin(listed)).join(F.broadcast(expanded), "term")
    found = found.join(F.broadcast(stats), F.col("field") == F.col("_f"))
    return found.select("token", "field", "term", "edits", scoring.idf(F.col("docs"), F.col("df")).alias("idf"), "mean"), listed


def needs_positions(request: SearchRequest) -> bool:
    return len(request.query.tokens) > 1


def token_matches(index: Index, request: SearchRequest) -> DataFrame:
    """(doc_id, field, token, contrib, edits[, positions]): the best of a word's expansions in each field.

    The candidates are at most ``EXPANSION`` * 2 + 1 for each word and field, so they are broadcast
    and the postings are not shuffled before the aggregation.
    """
    found, listed = candidates(index, request)
    wanted = F.col("field").isin([f.name for f in request.query_by]) & F.col("term").isin(listed)
    if "bucket" in index.postings.columns:
        wanted &= F.col("bucket").isin(sorted({bucket_of(t) for t in listed}))
    hits = index.postings.where(wanted).join(F.broadcast(found), ["field", "term"])
    contrib = scoring.bm25(F.col("idf"), F.col("tf"), F.col("len"), F.col("mean"))
    aggs = [F.max("contrib").alias("contrib"), F.min("edits").alias("edits")]
    columns = ["doc_id", "field", "token", contrib.alias("contrib"), "edits"]
    if needs_positions(request):
        columns.append("positions")
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    # Everything after this is by document: one exchange on doc_id serves all of it.
    return hits.select(*columns).repartition("doc_id").groupBy("doc_id", "field", "token").agg(*aggs)


def _phrase(positions: Column, first: int, last: int) -> Column:
    """Whether the map of token to positions has the tokens first..last side by side."""
    rest = lambda p: reduce(lambda a, b: a & b, [F.array_contains(positions[k], p + (k - first)) for k in range(first + 1, last + 1)])
    return F.coalesce(F.exists(positions[first], rest), F.lit(False))


def matches(index: Index, request: SearchRequest) -> DataFrame:
    """(doc_id, text_match) of every document that matches the words and phrases, filters aside."""
    words = request.query.tokens
    by_token = token_matches(index, request)
    allowed = sum(index.schema.typo.budget(len(w)) for w in words) if request.typos else 0
    order = F.create_map(*(x for i, f in enumerate(request.query_by) for x in (F.lit(f.name), F.lit(i))))
    boost = F.create_map(*(x for f in request.query_by for x in (F.lit(f.name), F.lit(float(f.weight)))))
    small = len(words) <= _MASK_BITS
    seen = F.bit_or(F.expr("shiftleft(1L, token)")) if small else F.collect_set("token")
    aggs = [F.sum("contrib").alias("bm25"), F.sum("edits").alias("used"), seen.alias("seen")]
    if needs_positions(request):
        aggs.append(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("positions"))
    by_field = by_token.groupBy("doc_id", "field").agg(*aggs).withColumn("boost", boost[F.col("field")])
    best = F.struct((F.col("bm25") * F.col("boost")).alias("boosted"), (-order[F.col("field")]).alias("order"))
    kept = ["bm25", "used", "boost", *(["positions"] if needs_positions(request) else [])]
    every = F.bit_or("seen") if small else F.array_distinct(F.flatten(F.collect_list("seen")))
    doc_aggs = [F.max_by(F.struct(*kept), best).alias("best"), every.alias("seen")]
    for k, (a, b) in enumerate(request.query.phrases):
        doc_aggs.append(F.max(_phrase(F.col("positions"), a, b)).alias(f"phrase{k}"))
    by_doc = by_field.groupBy("doc_id").agg(*doc_aggs)
    if request.match_all:
        by_doc = by_doc.where(F.col("seen") == (1 << len(words)) - 1 if small else F.size("seen") == len(words))
    for k in range(len(request.query.phrases)):
        by_doc = by_doc.where(F.col(f"phrase{k}"))
    if needs_positions(request):
        lists = F.map_values(F.col("best.positions"))
        near = scoring.proximity(lists, len(words))
    else:
        near = F.lit(1.0)
    popular = index.schema.field("popularity")
    value = F.lit(0.0)
    if popular and not popular.multi and popular.type in ("int", "float", "bool", "date"):
        own = index.docs.select(F.col("doc_id").alias("_d"), F.col("popularity").cast("double").alias("_p"))
        by_doc = by_doc.join(own, F.col("doc_id") == F.col("_d"))
        value = scoring.saturated(F.coalesce(F.col("_p"), F.lit(0.0)), scoring.POPULARITY_HALF)
    share = F.least(F.col("best.boost") / F.lit(index.schema.max_boost), F.lit(1.0))
    score = scoring.combined(F.col("best.bm25"), share, near, scoring.typo(F.col("best.used"), allowed), value)
    return by_doc.select("doc_id", F.round(score, 4).alias("text_match"))


def matched_documents(index: Index, request: SearchRequest) -> DataFrame:
    """The documents that match, with ``text_match``; without words, all that the filter lets through.

    The filter is applied to the documents before they meet the matches, so that it reaches the
    scan; the statistics behind the scores stay those of the whole collection. Of the documents only the
    columns that sorting and facets ask for are carried; the page fetches the rest for its rows.
    """
    docs = index.docs if request.filter is None else index.docs.where(request.filter)
    asked = dict.fromkeys(["doc_id", *(name for name, _ in request.sort or () if name in docs.columns), *(f.name for f in request.facets or ())])
    docs = docs.select(*(F.col(f"`{c}`") for c in asked))
    if not request.query.tokens:
        return docs.withColumn("text_match", F.lit(0.0))
    return docs.join(matches(index, request), "doc_id")


def page(matched: DataFrame, index: Index, request: SearchRequest) -> DataFrame:
    """The rows to show, in order."""
    ordered = matched.orderBy(*ordering(request.sort, index.schema))
    return (ordered.offset(request.offset) if request.offset else ordered).limit(request.limit)


def fetched(shown: DataFrame, index: Index) -> DataFrame:
    """A page with all columns of its documents, in order. Its ids, 250 at most, are looked up first, so that the
    scan of the documents skips what holds none of them."""
    rows = [(r["doc_id"], r["text_match"], i) for i, r in enumerate(shown.select("doc_id", "text_match").collect())]
    ranked = index.docs.sparkSession.createDataFrame(rows, "doc_id long, text_match double, _rank int")
    own = index.docs.where(F.col("doc_id").isin([r[0] for r in rows]))
    return own.join(F.broadcast(ranked), "doc_id").orderBy("_rank").drop("_rank")


@dataclass(frozen=True)
class SearchResult:
    """``shown`` and ``matched`` are lazy and narrow, ``facets`` (field, value, count) lazy and only if asked for."""

    index: Index
    shown: DataFrame
    matched: DataFrame
    facets: DataFrame | None
    found_is_exact: bool = True

    @property
    def hits(self) -> DataFrame:
        """The page's documents, in order."""
        return fetched(self.shown, self.index)

    @property
    def found(self) -> int:
        return self.matched.count()
