"""Every query with SQL gives what DuckDB gives; the others give rows."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from docloom.catalogue import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"
SLOW = {"phrase_merge_docs", "kmeans_labels", "k_selection", "lda_topics", "lda_dominant_topic", "lda_coherence"}

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if math.isnan(v) else f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_documents_and_classes_without_vectors(spark, duck, tmp_path):
    import shutil

    for name in ("documents", "benchmark"):
        shutil.copy(f"{TABLES}/{name}.parquet", tmp_path)
    spark.read.parquet(f"{TABLES}/embeddings.parquet").where("vec_id % 2 = 0").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    ids = [r[0] for r in duck.execute("select doc_id from documents order by 1").fetchall()]
    classes = duck.execute("select count(*) from benchmark").fetchone()[0]
    ranks = QUERIES["class_ranks"](spark, str(tmp_path)).collect()
    assert len(ranks) == len(ids) * classes
    assert sorted(r.rank_tfidf for r in ranks) == sorted(list(range(1, classes + 1)) * len(ids))
    assert {r.doc_id for r in ranks if r.rank_semantic} == {i for i in ids if i % 2 == 0}
    own = duckdb.connect()
    for f in glob.glob(f"{tmp_path}/*.parquet"):
        own.execute(f"create view {Path(f).stem} as select * from '{f}'")
    name = "classify_two_methods"
    df, cursor = QUERIES[name](spark, str(tmp_path)), own.execute(ORACLE_SQL[name])
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == ids
    assert all((r.semantic_top1 is None) == (r.top3 is None) == (r.ambiguous_gap is None) == (r.doc_id % 2 == 1) for r in rows)
    assert comparable(df.columns, rows) == comparable([c[0] for c in cursor.description], cursor.fetchall())


def test_models_take_the_whole_grids(spark, monkeypatch):
    from docloom import catalogue

    asked = []

    def scores(df, ks, vector="embedding", starts=1, seed=42):
        asked.append((list(ks), starts))
        return [(k, -abs(k - 30.5)) for k in ks]

    def labels(df, k, vector="embedding", starts=3, seed=42):
        asked.append((k, starts))
        return df.withColumn("cluster", df["label"])

    def fit(docs, **given):
        asked.append((docs.where("exists(tokens, w -> w like '%\\\\_%')").count() > 0, given))
        return catalogue.topics.TopicModel(None, None, [(4, 0.5), (5, 0.4)], 0)

    monkeypatch.setattr(catalogue.clusters, "k_scores", scores)
    monkeypatch.setattr(catalogue.clusters, "kmeans", labels)
    monkeypatch.setattr(catalogue.topics, "fit", fit)
    assert [r.k for r in QUERIES["k_selection"](spark, TABLES).collect() if r.chosen] == [30]
    QUERIES["kmeans_labels"](spark, TABLES)
    assert QUERIES["lda_grid_coherence"](spark, TABLES).count() == 2
    assert asked == [(list(range(5, 51)), 20), (10, 20), (True, {})]


def test_fitted_models(spark):
    labels = QUERIES["kmeans_labels"](spark, TABLES).select("cluster").distinct().count()
    assert labels == 10
    topics = QUERIES["lda_topics"](spark, TABLES).collect()
    assert sorted(r.topic_id for r in topics) == [0, 1, 2, 3] and all(len(r.keywords.split(", ")) == 7 for r in topics)


def test_without_the_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name="corpus_pipeline")
        return real(name, *args, **kwargs)

    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
