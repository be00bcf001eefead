import json

import pytest
from pyspark.sql import functions as F

from siftspark.engine import Engine, prometheus
from siftspark.operators import analytics
from siftspark.plans.errors import CollectionExists, CollectionNotFound, DocumentNotFound, QueryError, SchemaError
from siftspark.plans.filters import parse_filter
from siftspark.plans.request import resolve_search
from siftspark.plans.schema import CollectionSchema, FieldSchema, TypoConfig
from siftspark.sources.generator import PRODUCTS, products, query_mix
from siftspark.sources.ingest import live_snapshot, parse_documents

SHOP = CollectionSchema(
    "shop",
    (
        FieldSchema("title", "text"), FieldSchema("notes", "text", optional=True), FieldSchema("brand", "keyword", facet=True, optional=True), FieldSchema("tags", "keyword", facet=True, optional=True, multi=True),
        FieldSchema("price", "int", facet=True, filter=True, sort=True, optional=True), FieldSchema("rating", "float", filter=True, optional=True), FieldSchema("stock", "bool", facet=True, optional=True), FieldSchema("made", "date", sort=True, optional=True),
    ),
)
ITEMS = [
    {"id": "1", "title": "Quiet wireless mouse", "notes": "fits a mouse pad", "brand": "Ar", "tags": ["a", "b", "a"], "price": 30, "rating": 4.5, "stock": True, "made": "2024-01-01T00:00:00Z", "extra": {"kept": 1}},
    {"id": "2", "title": "Mouse pad", "brand": "Bo", "tags": ["b"], "price": 10, "rating": 4, "stock": False},
    {"id": 3, "title": "Wired keyboard", "notes": "for the desk", "brand": "Ar", "price": 50},
    {"id": "4", "title": "Pad for a mouse", "price": 10, "stock": True},
]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    collection = Engine(spark, str(tmp_path_factory.mktemp("engine"))).create_collection(SHOP)
    out = collection.upsert(ITEMS)
    assert out.where("error IS NULL").count() == 4
    return collection


def ids(result):
    return [r["id"] for r in result.hits.select("id").collect()]


def test_search(shop):
    assert set(ids(shop.search(q="mouse"))) == {"1", "2", "4"}
    assert ids(shop.search(q='"mouse pad"', query_by="title")) == ["2"]
    assert ids(shop.search(q='"mouse pad"')) == ["2", "1"]
    assert ids(shop.search(q="wir", typo_tolerance=False, sort="price:asc")) == ["1", "3"]
    assert ids(shop.search(q="keybaord")) == ["3"]
    assert ids(shop.search(q="keybaord", typo_tolerance=False)) == []
    assert set(ids(shop.search(q="keyboard pad", match_mode="any"))) == {"1", "2", "3", "4"}
    assert ids(shop.search(q="mouse", filter="price:<=10", sort="price:asc")) == ["2", "4"]
    assert ids(shop.search(q="", sort="made:desc", limit=2)) == ["1", "2"]
    assert ids(shop.search(q="mouse", limit=0)) == [] and shop.search(q="mouse", limit=0).found == 3


def test_json_and_facets(shop):
    out = shop.search_json(q="mouse", facet="brand,tags,stock,price")
    assert out["found"] == 3 and out["facets"] == {"brand": {"Ar": 1, "Bo": 1}, "tags": {"b": 2, "a": 1}, "stock": {"1": 2, "0": 1}, "price": {"10": 2, "30": 1}}
    assert next(h for h in out["hits"] if h["document"]["id"] == "1")["document"]["extra"] == {"kept": 1}


def test_suggest(shop):
    assert [(r["text"], r["edits"], r["count"]) for r in shop.suggest("quiet mou").collect()] == [("mouse", 0, 4)]
    assert [r["text"] for r in shop.suggest("wirel").collect()] == ["wireless", "wired"]
    with pytest.raises(QueryError):
        shop.suggest("x", limit=51)


def test_lifecycle(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    c = engine.create_collection(SHOP)
    with pytest.raises(CollectionExists):
        engine.create_collection(SHOP)
    assert c.live().count() == 0
    c.upsert([{"id": "a", "title": "one"}, {"id": "b", "title": "two"}, {"id": "a", "title": "three"}])
    bad = c.upsert([{"id": "c", "title": 5}, {"id": "d", "title": "four"}]).orderBy("seq").collect()
    assert bad[0]["error"] and bad[1]["error"] is None
    assert c.get("a") == {"id": "a", "title": "three"}
    assert c.delete("b") and not c.delete("b")
    with pytest.raises(DocumentNotFound):
        c.get("b")
    before = c.live().select("doc_id", "id").orderBy("id").collect()
    c.compact()
    again = Engine(spark, str(tmp_path)).collection("shop")
    assert again.live().select("doc_id", "id").orderBy("id").collect() == before and again.stats()["num_segments"] == 1
    assert again.schema == SHOP and [x["name"] for x in engine.list_collections()] == ["shop"]
    assert ids(again.search(q="three")) == ["a"] and engine.health()["collections"] == 1
    engine.drop_collection("shop")
    with pytest.raises(CollectionNotFound):
        engine.collection("shop")


def test_documents(spark):
    def parse(*docs):
        rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, value string")
        return parse_documents(rows, SHOP).orderBy("i", "nth").collect()

    bad = parse("{", 5, {"title": "x"}, {"id": "", "title": "x"}, {"id": "x" * 257, "title": "x"}, {"id": "1"}, {"id": "1", "title": None}, {"id": "1", "title": 1}, {"id": "1", "title": "x", "price": 3.5},
                {"id": "1", "title": "x", "price": "3"}, {"id": "1", "title": "x", "price": 1 << 63}, {"id": "1", "title": "x", "stock": 1}, {"id": "1", "title": "x", "made": "noon"},
                {"id": "1", "title": "x", "tags": [["a"]]}, {"id": "1", "title": "x", "tags": [1]}, {"id": "1", "title": "x", "rating": "4"}, {"id": True, "title": "x"})
    assert all(r["error"] for r in bad)
    good = parse({"id": 7, "title": "x", "price": None, "tags": "one", "rating": 3, "made": 5, "more": [1]}, [{"id": "a", "title": "y", "tags": ["p", None]}, {"id": "b", "title": "z", "price": -(1 << 63)}])
    assert [r["error"] for r in good] == [None] * 3
    assert good[0]["id"] == "7" and good[0]["tags"] == ["one"] and good[0]["rating"] == 3.0 and good[0]["made"] == 5 and json.loads(good[0]["source"])["more"] == [1]
    assert good[1]["tags"] == ["p", None] and good[2]["price"] == -(1 << 63)


@pytest.mark.parametrize(
    "schema",
    [
        CollectionSchema("1x", (FieldSchema("a", "text"),)), CollectionSchema("x", ()), CollectionSchema("x", (FieldSchema("id", "text"),)), CollectionSchema("x", (FieldSchema("_a", "text"),)),
        CollectionSchema("x", (FieldSchema("a", "text"), FieldSchema("a", "int"))), CollectionSchema("x", (FieldSchema("a", "text"), FieldSchema("b", "float", facet=True))),
        CollectionSchema("x", (FieldSchema("a", "text", sort=True),)), CollectionSchema("x", (FieldSchema("a", "text", boost=-1.0),)), CollectionSchema("x", (FieldSchema("a", "int"),)),
        CollectionSchema("x", (FieldSchema("a", "text"), FieldSchema("b", "int")), "b"), CollectionSchema("x", (FieldSchema("a", "text"),), None, TypoConfig(one_typo_min_len=9)),
    ],
)
def test_bad_schemas(schema):
    with pytest.raises(SchemaError):
        schema.validate()


@pytest.mark.parametrize("text", ["price", "price:", "price:x", "nope:1", "title:=x", "brand:<a", "price:[5..1]", "price:!=[1..2]", "price:<[1,2]", "(price:1", "price:1)", "price:1 && ", "brand:'x", "price:1.5", "stock:yes", "rating:nan"])
def test_bad_filters(text):
    with pytest.raises(QueryError):
        parse_filter(text, SHOP)


@pytest.mark.parametrize("params", [{"limit": 251}, {"limit": -1}, {"offset": 9_995}, {"sort": "price"}, {"sort": "price:up"}, {"sort": "brand:asc"}, {"sort": "price:asc,price:desc"}, {"facet": "rating"}, {"query_by": "price"}, {"query_by": " "}, {"match_mode": "most"}])
def test_bad_requests(params):
    with pytest.raises(QueryError):
        resolve_search(SHOP, **params)


@pytest.mark.parametrize(
    ("text", "want"),
    [("price:10", {"2", "4"}), ("price:!=10", {"1", "3"}), ("tags:a", {"1"}), ("tags:!=a", {"2"}), ("brand:=[Ar,'Bo']", {"1", "2", "3"}), ("brand:!=[Ar]", {"2"}), ("rating:>=4 && rating:<4.5", {"2"}), ("stock:true || price:>40", {"1", "3", "4"}),
     ("made:2024-01-01T00:00:00Z", {"1"}), ("made:>=0", {"1"}), ("price:[10..30]", {"1", "2", "4"}), ("(price:10)&&(stock:true)", {"4"})],
)
def test_filters(shop, text, want):
    assert {r["id"] for r in shop.live().where(parse_filter(text, SHOP)).select("id").collect()} == want


def test_filter_reaches_the_scan(spark, tmp_path):
    products(spark, 1000).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).where(parse_filter("price:<5000 && brand:=brand3", PRODUCTS)).select("doc_id")
    plan = df._jdf.queryExecution().toString()
    assert "LessThan(price" in plan and "EqualTo(brand,brand3)" in plan and "title" not in plan.split("ReadSchema")[1]
    assert len(query_mix(10)) == 10


def test_snapshot(spark):
    log = spark.createDataFrame([("a", 1, False), ("a", 3, True), ("b", 2, False), ("b", 5, False), ("c", 4, None), (None, 6, False)], "id string, seq int, deleted boolean")
    assert {(r["id"], r["seq"]) for r in live_snapshot(log).collect()} == {("b", 5), ("c", 4), (None, 6)}


def test_streaming_writes(spark, tmp_path):
    from siftspark.streaming.ingest import write_log

    source = tmp_path / "in"
    rows = [(json.dumps({"id": "a", "title": "x"}), "upsert", 1), (json.dumps({"id": "b", "title": "y"}), "upsert", 2), (json.dumps({"id": "a"}), "delete", 3), ("oops", "upsert", 4)]
    spark.createDataFrame(rows, "value string, op string, seq long").write.parquet(str(source))
    stream = spark.readStream.schema("value string, op string, seq long").parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        write_log(stream, SHOP, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out/log"))
    assert [r["id"] for r in live_snapshot(log).collect()] == ["b"]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1


def test_streamed_stats(spark, tmp_path):
    from siftspark.streaming.ingest import streamed_query_stats

    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS at, 'c' AS collection, 'q' AS query, 0L AS found UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'c', 'q', 3L UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'c', 'q', 3L").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, collection string, query string, found long").parquet(str(tmp_path / "in"))
    streamed_query_stats(stream).writeStream.outputMode("append").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["count"], r["zero_result_count"]) for r in spark.sql("SELECT * FROM stats").collect()] == [(2, 1)]


def test_analytics(spark):
    log = spark.createDataFrame([("c", "a", 0, 1, 1000), ("c", "a", 4, 3, 2000), ("c", "b", 0, 1000, 3000), ("c", " ", 1, 7, 11000)], "collection string, query string, found long, latency_us long, ts long")
    top = analytics.top_queries(log).collect()
    assert [(r["query"], r["count"], r["zero_result_count"], r["last_result_count"]) for r in top] == [("a", 2, 1, 4), ("b", 1, 1, 0)]
    assert [r["query"] for r in analytics.zero_result_queries(log, 1).collect()] == ["b"]
    assert {r["percentile"]: r["latency_us"] for r in analytics.latency(log).collect()} == {50: 4, 95: 1000, 99: 1000}
    assert {r["bucket"]: r["count"] for r in analytics.latency_histogram(log).collect()} == {0: 1, 1: 1, 2: 1, 9: 1}
    assert analytics.throughput(log).first()["per_second"] == 0.4
    assert analytics.latency(log.limit(0)).count() == 0
    assert "searches_total 4" in prometheus(log, [{"name": "c", "num_documents": 2}])


def test_scores_by_hand(shop):
    """One word, one field: the formula spelt out."""
    import math

    hit = shop.search(q="keyboard", query_by="title", prefix=False).hits.select("text_match").first()["text_match"]
    lengths = [3, 2, 2, 4]
    raw = math.log(1 + (4 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (sum(lengths) / 4)))
    assert hit == round(1000 * (0.45 * raw / (raw + 10) + 0.25 + 0.15 + 0.10), 4)


def test_best_field_and_ties(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).create_collection(SHOP)
    c.upsert([{"id": str(i), "title": "same words", "price": 9 - i} for i in range(5)])
    assert ids(c.search(q="same")) == ["0", "1", "2", "3", "4"]
    assert ids(c.search(q="same", sort="_text_match:desc,price:asc")) == ["4", "3", "2", "1", "0"]
    assert ids(c.search(q="same", offset=3, limit=5)) == ["3", "4"]
    assert c.search(q="same").matched.agg(F.countDistinct("text_match")).first()[0] == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_its_terms_only(spark):
    from siftspark import collections as C
    from siftspark.operators.index import bucket_of
    from siftspark.operators.search import matched_documents

    index = C.index(spark, "/root/testdata/sf0.001", "docs")
    plan = _plan(matched_documents(index, resolve_search(index.schema, q="the of", prefix=False, typo_tolerance=False, sort="n_chars:asc")))
    assert "In(term, [of,the])" in plan and "bucket#" in plan and all(str(bucket_of(t)) in plan for t in ("the", "of"))
    assert "struct<doc_id:bigint,n_chars:bigint>" in plan and "text:string" not in plan


def test_numbers_of_many_partitions(spark, tmp_path):
    schema = CollectionSchema("many", (FieldSchema("n", "int", sort=True), FieldSchema("title", "text")))
    many = Engine(spark, str(tmp_path)).create_collection(schema)
    for low in (0, 3000):
        rows = spark.range(low, low + 2400, 1, 1200).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("id").alias("n"), F.lit("x").alias("title"))).alias("value"))
        assert many.upsert(rows).where("error IS NULL").count() == 2400
    live = [r["n"] for r in many.live().orderBy("doc_id").select("n").collect()]
    assert live == [*range(2400), *range(3000, 5400)]
    assert many.live().agg(F.max("doc_id")).first()[0] < 10_000


def test_deleting_and_compacting_equals_rebuilding(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    made = [{"id": str(i), "title": f"word{i % 7} and word{i % 5} number {i}", "price": i} for i in range(120)]
    one = engine.create_collection(CollectionSchema("one", (FieldSchema("title", "text"), FieldSchema("price", "int", sort=True))))
    two = engine.create_collection(CollectionSchema("two", (FieldSchema("title", "text"), FieldSchema("price", "int", sort=True))))
    for low in (0, 40, 80):
        one.upsert(made[low : low + 40])
    for i in range(0, 12, 3):
        assert one.delete(str(i))
    one.compact()
    two.upsert([d for d in made if int(d["id"]) % 3 or int(d["id"]) >= 12])
    rows = lambda c: sorted(
        tuple(r) for r in c.index().postings.join(c.live().select("doc_id", "id"), "doc_id").select("id", "field", "term", "tf", "len", F.array_join("positions", ",")).collect()
    )
    assert rows(one) == rows(two)


@pytest.mark.parametrize("name", ["sort_field", "match_all_documents", "facet_keyword", "sort_date"])
def test_without_words_no_index_is_built(spark, monkeypatch, name):
    from siftspark import collections as C
    from siftspark.queries import QUERIES

    monkeypatch.setattr(C, "build", lambda *a: pytest.fail("an index was built"))
    monkeypatch.setattr(C, "_index", C._index.__wrapped__)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_postings_are_packed_by_term_in_slices(monkeypatch):
    import pyarrow as pa

    from siftspark.operators import index

    values = [[["a", "b", "a"], [], None, ["a"]], [], None, [["b"]], [["a"]] * 3]
    kinds = pa.list_(pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 5), pa.array(range(5), pa.int64()), pa.array(values, kinds)], ["field", "doc_id", "values"])
    every = {("a", 0, 4, (0, 2, 103)), ("b", 0, 4, (1,)), ("b", 3, 1, (0,)), ("a", 4, 3, (0, 101, 202))}
    for most, rows in ((100, 2), (1, 4)):
        monkeypatch.setattr(index, "SLICE", most)
        made = [r for part in index.grouped_by_term(iter([batch])) for r in part.to_pylist()]
        assert len(made) == rows and sum(r["begun"] for r in made) == 3 and sum(r["tokens"] for r in made) == 8
        assert {(r["term"], d, n, tuple(p)) for r in made for d, n, p in zip(r["doc_ids"], r["lens"], r["positions"], strict=True)} == every
        assert all(r["df"] == len(r["doc_ids"]) for r in made)


def test_one_scan_task_is_spread(spark):
    from siftspark import collections as C

    docs = spark.range(6000).coalesce(1).withColumnRenamed("id", "doc_id")
    assert C.spread(docs).rdd.getNumPartitions() == 13
    even = spark.range(0, 6000, 1, 8).withColumnRenamed("id", "doc_id")
    assert C.spread(even) is even
