"""Collections on shared storage, and what can be asked of them."""

from __future__ import annotations

import itertools
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.operators import analytics
from siftspark.operators.facets import facet_counts
from siftspark.operators.index import Index, build
from siftspark.operators.search import SearchResult, matched_documents, page
from siftspark.operators.suggest import suggest
from siftspark.plans.errors import CollectionExists, CollectionNotFound, DocumentNotFound
from siftspark.plans.request import resolve_search
from siftspark.plans.schema import CollectionSchema
from siftspark.sources.ingest import live_snapshot, parse_documents


class _Files:
    """The Hadoop file system under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._of(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._of(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self._of(path), True)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._of(path)).getLength() if self.exists(path) else 0

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self._of(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._of(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark, folder)

    def _schema_path(self, name: str) -> str:
        return f"{self.folder}/{name}/schema.json"

    def create_collection(self, schema: CollectionSchema) -> Collection:
        schema.validate()
        if self.files.exists(self._schema_path(schema.name)):
            raise CollectionExists(schema.name)
        self.files.write(self._schema_path(schema.name), schema.to_json())
        return Collection(self, schema)

    def collection(self, name: str) -> Collection:
        if not self.files.exists(self._schema_path(name)):
            raise CollectionNotFound(name)
        return Collection(self, CollectionSchema.from_json(self.files.read(self._schema_path(name))))

    def list_collections(self) -> list[dict]:
        names = [n for n in self.files.names(self.folder) if self.files.exists(self._schema_path(n))]
        return [self.collection(n).stats() for n in names]

    def drop_collection(self, name: str) -> None:
        self.collection(name)
        self.files.delete(f"{self.folder}/{name}")

    def health(self) -> dict:
        return {"status": "ok", "collections": len(self.list_collections())}


class Collection:
    """A log of batches, each a Parquet folder, whose latest rows are live; and an index built from them."""

    def __init__(self, engine: Engine, schema: CollectionSchema):
        self.engine, self.schema, self.spark = engine, schema, engine.spark
        self.folder = f"{engine.folder}/{schema.name}"
        self._index: Index | None = None

    def _batches(self) -> list[str]:
        return [n for n in self.engine.files.names(f"{self.folder}/log") if n.startswith("batch=") and self.engine.files.exists(f"{self.folder}/log/{n}/_SUCCESS")]

    def _log_schema(self) -> str:
        return ", ".join(["source string", "id string", *(f"`{f.name}` {f.spark_type}" for f in self.schema.fields), "seq bigint", "deleted boolean"])

    def _append(self, rows: DataFrame) -> None:
        self._index = None
        number = max([-1, *(int(n.removeprefix("batch=").split("-")[0]) for n in self._batches())]) + 1
        rows.write.parquet(f"{self.folder}/log/batch={number:012d}-{uuid.uuid4().hex[:8]}")

    def _next_seq(self) -> int:
        return (self._log().agg(F.max("seq")).first()[0] or 0) + 1

    def _log(self) -> DataFrame:
        names = self._batches()
        if not names:
            return self.spark.createDataFrame([], self._log_schema())
        return self.spark.read.schema(self._log_schema()).parquet(*(f"{self.folder}/log/{n}" for n in names))

    def upsert(self, documents: DataFrame | list[dict] | dict) -> DataFrame:
        """Adds documents (a column ``value`` of JSON texts, or Python objects), later ones of an id winning.

        Returns (seq, id, error) of each, error being null where it was taken.
        """
        if not isinstance(documents, DataFrame):
            listed = documents if isinstance(documents, list) else [documents]
            documents = self.spark.createDataFrame([(json.dumps(d),) for d in listed], "value string")
        # Partition and row are kept in one number, and turned into dense numbers in the order of the input.
        parsed = durable(parse_documents(documents.select("value"), self.schema).drop("nth").withColumn("_at", F.monotonically_increasing_id()))
        partition, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
        counts = sorted(tuple(r) for r in parsed.groupBy(partition).count().collect())
        starts = list(itertools.accumulate([self._next_seq(), *(n for _, n in counts)]))[:-1]
        # One row of 12 bytes for each partition.
        offsets = self.spark.createDataFrame([(p, n) for (p, _), n in zip(counts, starts, strict=True)], "_partition long, _start long")
        parsed = parsed.join(F.broadcast(offsets), partition == F.col("_partition")).withColumn("seq", F.col("_start") + row).drop("_at", "_partition", "_start")
        good = parsed.where("error IS NULL").drop("error").withColumn("deleted", F.lit(False))
        self._append(good)
        return parsed.select("seq", "id", "error")

    def delete(self, id_: str) -> bool:
        """Whether there was a live document of that id, which there is no more."""
        if self.live().where(F.col("id") == id_).isEmpty():
            return False
        row = self.spark.createDataFrame([(id_, self._next_seq(), True)], "id string, seq long, deleted boolean")
        blank = [F.lit(None).cast(f.spark_type).alias(f.name) for f in self.schema.fields]
        self._append(row.select(F.lit(None).cast("string").alias("source"), "id", *blank, "seq", "deleted"))
        return True

    def live(self) -> DataFrame:
        """(doc_id, id, source, the fields); doc_id ascends with the time of the write."""
        return live_snapshot(self._log()).withColumnRenamed("seq", "doc_id").drop("deleted")

    def get(self, id_: str) -> dict:
        row = self.live().where(F.col("id") == id_).select("source").first()
        if row is None:
            raise DocumentNotFound(id_)
        return json.loads(row["source"])

    def compact(self) -> None:
        """One batch of the live rows in place of all; rows keep their numbers."""
        before = self._batches()
        self._append(self.live().withColumnRenamed("doc_id", "seq").withColumn("deleted", F.lit(False)))
        for name in before:
            self.engine.files.delete(f"{self.folder}/log/{name}")

    def stats(self) -> dict:
        return {"name": self.schema.name, "num_documents": self.live().count(), "num_segments": len(self._batches()), "bytes": self.engine.files.size(f"{self.folder}/log"), "schema": self.schema}

    def index(self, folder: str | None = None) -> Index:
        """The index of the live documents, written below the collection's folder once a change."""
        if self._index is None:
            path = folder or f"{self.folder}/index-{uuid.uuid4().hex[:8]}"
            build(self.live(), self.schema).write(path)
            self._index = Index.read(self.spark, self.schema, path)
        return self._index

    def search(self, **params) -> SearchResult:
        request = resolve_search(self.schema, **params)
        index = self.index()
        matched = matched_documents(index, request)
        facets = facet_counts(matched, request.facets) if request.facets else None
        return SearchResult(index, page(matched, index, request), matched, facets)

    def search_json(self, **params) -> dict:
        """The page as plain objects, with the count of all matches and the facets."""
        began = time.perf_counter()
        result = self.search(**params)
        result.matched.persist()
        hits = [{"document": json.loads(r["source"]), "text_match": r["text_match"]} for r in result.hits.collect()]
        out = {"found": result.found, "found_is_exact": True, "hits": hits}
        if result.facets is not None:
            counts: dict[str, dict[str, int]] = {name.strip(): {} for name in params["facet"].split(",") if name.strip()}
            for r in result.facets.collect():
                counts[r["field"]][r["value"]] = r["count"]
            out["facets"] = counts
        result.matched.unpersist()
        out["search_time_ms"] = (time.perf_counter() - began) * 1000
        return out

    def suggest(self, q: str, **params) -> DataFrame:
        return suggest(self.index(), q, **params)


def prometheus(log: DataFrame, collections: list[dict]) -> str:
    """Counts and latencies in the text form that scrapers read."""
    total = log.count()
    lines = ["# TYPE searches_total counter", f"searches_total {total}", "# TYPE collection_documents gauge"]
    lines += [f'collection_documents{{collection="{c["name"]}"}} {c["num_documents"]}' for c in collections]
    lines += ["# TYPE search_latency_us gauge"] + [f'search_latency_us{{quantile="0.{r["percentile"]}"}} {r["latency_us"]}' for r in analytics.latency(log).collect()]
    return "\n".join(lines) + "\n"
