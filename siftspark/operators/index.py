"""The index tables of a collection: postings, lengths, statistics, dictionary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import VALUE_GAP, terms
from siftspark.plans.schema import CollectionSchema

BUCKETS = 16
#: Tokens that a Python worker groups at once; a document that has more is one slice.
SLICE = 400_000
TABLES = ("docs", "postings", "stats", "terms")
_PACKED = "field string, term string, doc_ids array<bigint>, lens array<int>, positions array<array<int>>, df int, begun int, tokens bigint"


@dataclass(frozen=True)
class Index:
    """``docs`` (doc_id, typed columns), ``packed`` (field, term, doc_ids, lens, positions, df, begun, tokens), ``stats`` (field, docs, tokens),
    ``terms`` (field, term, df, chars). Without words only ``docs`` is read, and the others may be None.

    A packed row has a term's postings of one slice of documents. ``begun`` counts the documents whose first token the term is.
    """

    schema: CollectionSchema
    docs: DataFrame
    packed: DataFrame | None
    stats: DataFrame | None
    terms: DataFrame | None

    @property
    def postings(self) -> DataFrame:
        """(field, term, doc_id, tf, len, positions), and the bucket where the index was written."""
        kept = [c for c in ("field", "bucket", "term") if c in self.packed.columns]
        each = self.packed.select(*kept, F.inline(F.arrays_zip("doc_ids", "lens", "positions")).alias("doc_id", "len", "positions"))
        return each.select(*kept, "doc_id", F.size("positions").alias("tf"), "len", "positions")

    def write(self, path: str) -> None:
        """As Parquet: postings in a folder for each field and hash of the term, sorted by term within it.

        A search for known terms reads their folders only, and few row groups of those. The documents are
        tokenised once and postings shuffled once, packed; a folder that one frequent term fills is split by the
        rebalancing. Statistics and dictionary are made of what was written.
        """
        self.docs.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
        by_term = self.packed.withColumn("bucket", term_bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("field", "bucket", "term")
        by_term.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/postings")
        written = from_packed(self.docs, self.docs.sparkSession.read.parquet(f"{path}/postings"), self.schema)
        written.stats.write.mode("overwrite").parquet(f"{path}/stats")
        written.terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, schema: CollectionSchema, path: str) -> Index:
        # The postings' field and bucket are names of folders, which pruning knows without reading.
        return Index(schema, *(spark.read.parquet(f"{path}/{t}") for t in TABLES))

    def cached(self) -> Index:
        return Index(self.schema, self.docs, *(t.persist() for t in (self.packed, self.stats, self.terms)))


def term_bucket(term: Column) -> Column:
    """The folder of a term; ``bucket_of`` is the same on the driver."""
    return (F.crc32(term) % BUCKETS).cast("int")


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def tokens(docs: DataFrame, schema: CollectionSchema) -> DataFrame:
    """(field, doc_id, values): the tokens of each value of each searchable field of each document."""
    parts = []
    for f in schema.searchable:
        own = F.col(f"`{f.name}`")
        # A token that folds to nothing takes no position.
        values = F.transform(own, terms) if f.multi else F.array(F.filter(terms(own), lambda t: t != ""))
        parts.append(docs.select(F.lit(f.name).alias("field"), F.col("doc_id").cast("long").alias("doc_id"), values.alias("values")))
    return reduce(DataFrame.unionByName, parts)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]))


def grouped_by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed postings of documents whose tokens are in one row, without a shuffle. What is held beyond
    the batch grows with ``SLICE`` only."""
    for batch in batches:
        ends = np.append(0, np.cumsum(_sizes(batch.column("values").flatten())))[np.cumsum(_sizes(batch.column("values")))]
        begin = before = 0
        while begin < len(ends) and before < ends[-1]:
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            if ends[end - 1] > before:
                yield _packed(batch.slice(begin, end - begin))
            begin, before = end, ends[end - 1]


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = batch.column("values").flatten()
    many, sizes = _sizes(batch.column("values")), _sizes(values)
    of_value = np.repeat(np.arange(len(many)), many)
    row = np.repeat(of_value, sizes)
    lens = np.bincount(row, minlength=len(many))
    # Each value starts a gap behind the one before it that has tokens.
    step = np.where(sizes > 0, sizes + VALUE_GAP, 0)
    low = np.cumsum(step) - step
    low -= low[(np.cumsum(many) - many)[of_value]]
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)
    coded, fields = values.flatten().dictionary_encode(), batch.column("field").dictionary_encode()
    key = fields.indices.to_numpy().astype(np.int64)[row] * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row, place = key[order], row[order], place[order].astype(np.int32)
    posting = _starts(key, row)
    kinds, docs = key[posting], row[posting]
    term = _starts(kinds)
    upto = np.append(term, len(posting)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(np.append(posting, len(row)).astype(np.int32)), pa.array(place))
    columns = [
        fields.dictionary.take(pa.array(kinds[term] // len(coded.dictionary))), coded.dictionary.take(pa.array(kinds[term] % len(coded.dictionary))),
        pa.ListArray.from_arrays(upto, batch.column("doc_id").take(pa.array(docs))), pa.ListArray.from_arrays(upto, pa.array(lens[docs].astype(np.int32))), pa.ListArray.from_arrays(upto, positions),
        pa.array(np.diff(upto)), pa.array(np.add.reduceat(place[posting] == 0, term, dtype=np.int32)), pa.array(np.diff(np.append(posting[term], len(row)))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["field", "term", "doc_ids", "lens", "positions", "df", "begun", "tokens"])


def build(docs: DataFrame, schema: CollectionSchema) -> Index:
    """Index tables of live documents. ``docs`` has a distinct long ``doc_id`` and the schema's columns.

    A document's tokens are in one row, so its postings are made without a shuffle. Statistics and the
    dictionary come from the counts beside the packed postings, which are far fewer rows.
    """
    return from_packed(docs, tokens(docs, schema).mapInArrow(grouped_by_term, _PACKED), schema)


def from_packed(docs: DataFrame, packed: DataFrame, schema: CollectionSchema) -> Index:
    stats = packed.groupBy("field").agg(F.sum("begun").alias("docs"), F.sum("tokens").alias("tokens"))
    dictionary = packed.groupBy("field", "term").agg(F.sum("df").alias("df")).withColumn("chars", F.char_length("term"))
    return Index(schema, docs, packed, stats, dictionary)
