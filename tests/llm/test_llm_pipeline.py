"""The pipeline's stages on their own input against plain versions, and on odd rows."""

import importlib
import re

import corpus_pipeline
import pytest
from raingrid.llm import decontaminate
from test_llm_operators import ODD, plain_duplicates, words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, score string"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialise(stage(spark, docs, DATA), "test")
        out.append((name, docs, kept))
        docs = kept
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_names_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality classifier", "language ID", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, before, after in stages[:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert ids(after) <= ids(before)


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    _, before, after = stages[0]
    good = [i for i in ids(before) if labels.get(i) == 1]
    junk = [i for i in ids(before) if labels.get(i) == 0]
    kept = ids(after)
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in junk) <= 0.5 * len(junk)


def test_language_rejects_only_texts_without_language(stages):
    _, before, after = stages[1]
    gone = ids(before) - ids(after)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(not any(map(str.isalpha, texts[i] or "")) for i in gone)


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    want = plain_duplicates([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {i for i, (_, low) in want.items() if low == i}


def test_documents_with_passages_go(spark, stages):
    _, before, after = stages[3]
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in before.collect() if any(i in decontaminate.normalise(r["text"] or "") for i in items)}
    assert held and ids(before) - ids(after) == held


def test_all_documents_are_packed(stages):
    _, before, after = stages[4]
    assert ids(after) == ids(before)
    used = {}
    for r in after.collect():
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1.05 * sum(used.values()) / 2048 + 1


def test_odd_rows(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows and columns of the operators' own names."""
    bench = words(40, 9)
    rows = [(k, words(30, k), "en", "s", None, "mine", k, "x") for k in range(40)] + [(i, t, None, None, None, "mine", 1, "x") for i, t in ODD] + [(50, f"x {bench}", "en", "s", 1, "mine", 1, "x")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    d = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, d), "test")
        if k < 4:
            assert docs.columns == before.columns and {r["kept"] for r in docs.collect()} == {"mine"}
            assert set(range(40)) <= ids(docs)
    assert 50 not in ids(docs) and 904 in ids(docs)


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null ids, repeated rows and shared ids are judged row by row."""
    bench, a, b, c = words(40, 9), words(60, 61), words(60, 62), words(60, 63)
    texts = [(1, a), (None, a), (2, b), (2, b), (None, c), (None, f"x {bench} y"), (3, f"{words(9, 64)} {bench}"), (3, words(60, 65)), (None, None), (None, ""), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "mine", 1, "x") for i, t in texts], SCHEMA)
    d = str(tmp_path)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    once = corpus_pipeline.near_duplicate(spark, docs, d)
    assert once.columns == docs.columns
    left = rows(once)
    assert left.count((1, a)) == 1 and (None, a) not in left and left.count((2, b)) == 1 and (None, c) in left and left.count((4, None)) == 2 and (None, None) in left and (None, "") in left
    clean = corpus_pipeline.decontaminate(spark, docs, d)
    assert rows(clean) == sorted(((i, t) for i, t in texts if bench not in (t or "")), key=str)


def test_empty_tables(spark, tmp_path):
    docs, d = spark.createDataFrame([], SCHEMA), str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, d), "test")
        assert docs.count() == 0


def test_registered_with_the_entry():
    entry = importlib.import_module("__spark_entry__")
    own = entry.queries()
    assert {"pipeline"} | {n for n in own if re.match(r"op\d+_", n)} <= set(own)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in own if re.match(r"op\d+_", n)) == list(range(1, 14))
