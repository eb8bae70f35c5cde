"""Similarity network of clusters, from the texts of their members."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from newsatlas.operators.keys import bucketed_lag, ranked_list, top_per_key
from newsatlas.operators.semantic import TOKEN, counted, with_bigrams

RANGE = 100_000  # articles per range of the token hand-over


def cluster_terms(corpus: DataFrame, seq: str = "seq", text: str = "texto_busca_normalizado", width: int = RANGE) -> DataFrame:
    """(cluster_id, term, tf) of the joined text of each cluster, never building that text.

    Members are read in ``seq`` order; the pair made of the last token of one article and the first of
    the next is counted too, as it is in the joined text.
    """
    rows = corpus.where("cluster_id IS NOT NULL").select(
        "cluster_id", F.col(seq).cast("long").alias("seq"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0).alias("w")
    ).where(F.size("w") > 0)
    inner = rows.select("cluster_id", F.inline(counted(with_bigrams("w"))))
    ends = rows.select("cluster_id", "seq", F.element_at("w", 1).alias("head"), F.element_at("w", -1).alias("tail"))
    joints = bucketed_lag(ends, "cluster_id", "seq", "tail", width, "before").where("before IS NOT NULL")
    seams = joints.select("cluster_id", F.concat_ws(" ", "before", "head").alias("term"), F.lit(1).alias("tf"))
    return inner.unionByName(seams).groupBy("cluster_id", "term").agg(F.sum("tf").alias("tf"))


def cluster_weights(
    terms: DataFrame, n_clusters: int, min_df: int = 2, max_df: float = 0.75, max_features: int = 12_000
) -> DataFrame:
    """(cluster_id, term, weight): unit-length TF-IDF rows, at most clusters x max_features of them."""
    stats = terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_clusters)).orderBy(F.desc("tf"), "term").limit(max_features)
    idf = kept.select("term", (F.log((F.lit(1.0) + n_clusters) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    raw = terms.join(F.broadcast(idf), "term").select("cluster_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster_id")))  # max_features rows at most
    return raw.select("cluster_id", "term", (F.col("w") / norm).alias("weight"))


def dominant_terms(weights: DataFrame, k: int = 6) -> DataFrame:
    ranked = weights.where("weight > 0").withColumn("weight", F.round("weight", 6))
    return top_per_key(ranked, ["cluster_id"], [F.desc("weight"), F.asc("term")], k).groupBy("cluster_id").agg(
        ranked_list("term").alias("dominant_terms")
    )


def network_edges(weights: DataFrame, neighbours: int = 3, min_similarity: float = 0.12, shared: int = 6) -> DataFrame:
    """Undirected edges between clusters: each cluster's best partners above the floor.

    The source is the smallest cluster that has the other among its best partners.

    Both sides hold cluster-level rows (clusters x vocabulary at most), never articles.
    """
    a = weights.select(F.col("cluster_id").alias("a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col("cluster_id").alias("b"), "term", F.col("weight").alias("wb"))
    common = a.join(b, "term").where("a < b")
    sims = common.groupBy("a", "b").agg(
        F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity"), F.count(F.lit(1)).cast("int").alias("shared_count")
    ).where(F.col("similarity") >= min_similarity)
    both = sims.select("a", "b", "similarity", "shared_count").unionByName(
        sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "shared_count")
    )
    best = top_per_key(both, ["a"], [F.desc("similarity"), F.asc("b")], neighbours).withColumnRenamed("a", "finder")
    edges = best.groupBy(F.least("finder", "b").alias("a"), F.greatest("finder", "b").alias("b")).agg(
        F.min("finder").alias("source"), F.any_value("similarity").alias("similarity"), F.any_value("shared_count").alias("shared_count")
    )
    strength = common.join(edges.select("a", "b"), ["a", "b"], "left_semi").select(
        "a", "b", "term", F.round(F.least("wa", "wb"), 6).alias("m")
    )
    lists = top_per_key(strength, ["a", "b"], [F.desc("m"), F.asc("term")], shared).groupBy("a", "b").agg(ranked_list("term").alias("t"))
    return edges.join(lists, ["a", "b"]).select(
        F.col("source").alias("source_cluster"), (F.col("a") + F.col("b") - F.col("source")).alias("target_cluster"), F.round("similarity", 4).alias("similarity"),
        "shared_count", F.array_join("t", " | ").alias("shared_terms"),
    ).orderBy(F.desc("similarity"), F.desc("shared_count"), "source_cluster", "target_cluster")


def layout(weights: DataFrame) -> DataFrame:
    """(cluster_id, x, y, z): leading three components, each axis scaled so that its coordinate furthest from 0 is 1.

    The components follow from the products between clusters: one number per pair of clusters, which is all
    that reaches the driver.
    """
    spark = weights.sparkSession
    a = weights.select(F.col("cluster_id").alias("a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col("cluster_id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")).collect()
    ids = sorted({r["a"] for r in dots})
    place = {c: i for i, c in enumerate(ids)}
    products = np.zeros((len(ids), len(ids)))
    for r in dots:
        products[place[r["a"]], place[r["b"]]] = r["dot"]
    k = max(0, min(3, min(len(ids), weights.select("term").distinct().count()) - 1))
    coords = np.zeros((len(ids), 3))
    if k:
        values, vectors = np.linalg.eigh((products + products.T) / 2)
        coords[:, :k] = (vectors * np.sqrt(np.maximum(values, 0.0)))[:, ::-1][:, :k]
    if len(coords):
        ends = coords[np.abs(coords).argmax(axis=0), range(3)]
        coords = coords / np.where(ends != 0, ends, 1.0)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in zip(ids, coords)], "cluster_id int, x double, y double, z double")


def network_nodes(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes with place, cluster facts and dominant terms."""
    facts = clusters.select("cluster_id", "size", "active_years", "top_terms", "top_tags", "top_crimes")
    named = dominant_terms(weights).select("cluster_id", F.array_join("dominant_terms", " | ").alias("dominant_terms"))
    return layout(weights).join(facts, "cluster_id").join(named, "cluster_id", "left").orderBy("cluster_id")


def place_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends."""
    at = lambda end: F.broadcast(nodes.select(F.col("cluster_id").alias(f"{end}_cluster"), *[F.col(c).alias(f"{end}_{c}") for c in "xyz"]))
    return edges.join(at("source"), "source_cluster").join(at("target"), "target_cluster")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("source_cluster").alias("cluster_id")).union(edges.select("target_cluster")).distinct()
    return nodes.join(ends, "cluster_id", "left_anti")
