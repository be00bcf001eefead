import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_llm import sentence

NAMES = ["op1_minhash", "op2_line_dedup", "op3_embedding_dedup", "op4_mixing", "op5_toxicity", "op6_suffix_array", "op7_secrets", "op8_sharding", "op9_fingerprints", "op10_packing", "pipeline"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with planted toxic documents, repeated lines and near copies."""
    rng = random.Random(20)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocabulary = sentence(rng, 400).split()
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    foul = ["zzfoul", "zzvile", "zzgrim"]
    texts = []
    for i in range(200):
        lines = [line(rng.randint(10, 25)) for _ in range(4)]
        if i % 5 == 0:
            lines[1] += " " + " ".join(rng.choice(foul) for _ in range(8))
        if i % 7 == 3:
            lines.append("the very same footer line in many documents")
        texts.append("\n".join(lines))
    for i in range(1, 200, 10):  # near copies, each line changed beyond what line dedup joins
        lines = [w.split() for w in texts[i].split("\n")]
        for w in lines:
            w[len(w) // 2] = "changedhere"
        texts.append("\n".join(map(" ".join, lines)))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.where("n_chars <> length(text)").count() == 0
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean, lines, groups, mixed = kept
    toxic = {i for i in range(200) if i % 5 == 0}
    assert set(clean) == set(every) - toxic
    footer = "the very same footer line in many documents"
    assert sum(footer in t for t in lines.values()) == 1 and all(t.replace(f"\n{footer}", "") in clean[i] for i, t in lines.items())
    copies = {200 + k: 1 + 10 * k for k in range(20)}
    assert not [c for c, i in copies.items() if c in groups and i in groups] and len(groups) >= len(lines) - 20
    assert all(t == groups[i] for i, t in mixed.items())
    bins = docs.collect()
    assert all(r["tokens"] <= 2048 for r in bins) and {d for r in bins for d in r["doc_ids"]} == set(mixed)
    assert sum(r["tokens"] for r in bins) == sum(len(t.split()) * n for t, n in ((mixed[r["doc_id"]], r["count"]) for r in spark.read.parquet(str(tmp_path / "mixing")).groupBy("doc_id").count().collect()))


def test_run_and_awkward_rows(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    from tests.llm.test_llm import awkward

    folder = str(tmp_path)
    awkward(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_all_registered():
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op4_mixing", "op6_suffix_array", "op7_secrets"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name]).df()[columns]
    assert sorted(map(tuple, got.select(*columns).toPandas().to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
