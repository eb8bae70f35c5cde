"""The semantic space over many rows: what is stored and shuffled, and fits that share their passes."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newsatlas.operators import kmeans, semantic, term_counts


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(4, 6)) * 4
    rows = [(f"d{i}", (middles[i % 4] + rng.normal(size=6)).tolist()) for i in range(400)]
    return spark.createDataFrame(rows, "link string, vec array<double>").repartition(3).cache()


def test_fits_share_their_passes(spark, groups, monkeypatch):
    passes = []
    inner = kmeans.added_up
    monkeypatch.setattr(kmeans, "added_up", lambda *a: passes.append(1) or inner(*a))
    best, scores = semantic.choose_k(groups, "link", candidates=(2, 4, 7), n_init=5)
    assert best == 4 and set(scores) == {2, 4, 7} and len(passes) <= kmeans.STEPS + kmeans.ROUNDS + 4


def test_fits_are_as_good_as_those_of_spark(spark, groups):
    fits = kmeans.fit_all(kmeans.blocks(groups), [(4, 42 + i) for i in range(5)])
    data = groups.select(array_to_vector("vec").alias("features"))
    assert min(f.cost for f in fits) <= min(KMeans(k=4, seed=i).fit(data).summary.trainingCost for i in range(3)) * 1.001
    assert all(f.sizes.sum() == 400 and len(f.centres) == 4 for f in fits)


def test_silhouettes_are_those_of_the_evaluator(spark, groups):
    rows, centres = semantic.nearest_centre(groups, "link", 4, n_init=2)
    found = kmeans.cosine_silhouettes(kmeans.blocks(groups), [np.array(centres), np.array(centres[:2])])
    assert found[0] == pytest.approx(semantic.silhouette(rows), abs=1e-9)
    with_zeros = groups.unionByName(spark.createDataFrame([("z", [0.0] * 6)], groups.schema))
    assert np.isfinite(kmeans.cosine_silhouettes(kmeans.blocks(with_zeros), [np.array(centres)])[0])


def test_rows_belong_to_their_nearest_centre(spark, groups):
    rows, centres = semantic.nearest_centre(groups, "link", 7, n_init=2)
    for r in rows.collect():
        away = ((np.array(r["vec"]) - np.array(centres)) ** 2).sum(axis=1)
        assert away[r["cluster_id"]] == away.min()


def test_fewer_distinct_rows_than_centres(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(6)], "i int, vec array<double>")
    assert len({r["cluster_id"] for r in semantic.assign_clusters(rows, "i", 4, n_init=2).collect()}) == 2


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_vocabulary_from_hashes_is_the_whole_one(spark, most, monkeypatch):
    monkeypatch.setattr(term_counts, "CHUNK", 500)
    rng = random.Random(7)
    docs = [(i, [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(0, 30))]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(docs, "i int, terms array<string>").repartition(4)
    whole = semantic.vocabulary(semantic.term_stats(df), 301, max_features=most).collect()
    fitted = semantic.fit_tfidf(df, max_features=most)
    assert sorted(fitted.terms) == sorted(r["term"] for r in whole)
    found = term_counts.frequent_hashes(df, "terms", 301, 3, 0.8, most)
    assert set(term_counts.hashes(__import__("pyarrow").array([r["term"] for r in whole]))) <= set(found)
    counts = {r["term"]: (r["tf"], r["df"]) for r in semantic.term_stats(df).collect()}
    own = [t for _, ts in docs for t in ts or []]
    assert all(counts[t] == (own.count(t), sum(t in (ts or []) for _, ts in docs)) for t in set(own[:50])) and set(counts) == set(own)


def test_terms_are_made_without_the_stored_news(spark, tmp_path):
    from newsatlas.plans.catalog import registry, semantic as queries

    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("um texto sobre carga numero "), F.chr(F.col("id") % 20 + 97), F.lit(" e mais.")).alias("text"),
        F.lit("pt").alias("lang"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_chars"),
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    terms = queries.terms(spark, str(tmp_path))
    assert all({"texto", "carga", "texto carga"} & set(r["terms"]) for r in terms.collect())
    kept = {name: df for (_, folder, name), df in registry._STAGES.items() if folder == str(tmp_path)}
    assert set(kept) == {"words"} and kept["words"].columns == ["doc_id", "link", "words"]
