"""Connected components and the series built from recurring pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsatlas.functions import series as fn
from newsatlas.functions.dates import span_days
from newsatlas.operators.keys import consecutive_ids, lookup, ranked_list
from newsatlas.operators.summaries import first_titles, modes, profile, span_columns
from newsatlas.session import cut


def components(edges: DataFrame, source: str = "source_link", target: str = "target_link") -> DataFrame:
    """(node, component): the smallest node of each connected component, for nodes with an edge.

    Each round offers a node the smallest label among its neighbours, and the same to the label that the node had, so
    that whole trees of labels move at once; then it follows the label of that label. Long chains shrink fast in whatever
    order their keys stand; rounds go on until no label changes. Hubs are hot keys of the two joins, and ``lookup`` keeps
    them apart. Every round is written out, so a lost executor replays one round.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    links = cut(pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        known = labels.withColumnRenamed("node", "a")
        offers = lookup(links, known, "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        own = F.struct("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        hook = F.struct(F.col("label").alias("node"), F.lit(None).alias("old"), F.col("offer").alias("label"))
        told = labels.join(offers, "node").select(F.inline(F.array(own, hook)))
        nearer = cut(told.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(lookup(nearer, jump, "label").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _described(members: DataFrame, group: str, size: Column) -> DataFrame:
    """Metrics and ranked lists of each group of articles."""
    spans = [c for c in span_columns()[1:]]
    facts = members.groupBy(group).agg(size.cast("int").alias("size"), *spans)
    names = F.array_compact(F.array(F.nullif("nome_operacao", F.lit(""))))
    tops = profile(members, group, {"ops": (names, 5), "crimes": (F.col("crime_labels"), 5)})
    cluster = modes(members, group, "cluster_id").groupBy(group).agg(ranked_list("cluster_id").alias("modes"))
    titles = first_titles(members.where("titulo IS NOT NULL"), group).groupBy(group).agg(ranked_list("titulo").alias("titles"))
    joined = facts.join(tops, group, "left").join(cluster, group, "left").join(titles, group, "left")
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, empty) for c in ("ops", "crimes", "titles")} | {"modes": F.coalesce("modes", F.array().cast("array<int>"))}
    joined = joined.withColumns(lists)
    return joined.withColumn("series_label", fn.series_label("ops", "crimes", "titles", "modes"))


def _layout(described: DataFrame, series_id: Column | str) -> DataFrame:
    """Series columns in their published order."""
    packed = lambda c, sep=" | ": F.array_join(c, sep)
    sid = F.col(series_id) if isinstance(series_id, str) else series_id
    return described.withColumn("semantic_series_id", sid.cast("long")).select(
        "semantic_series_id", "size", "first_date", "last_date", span_days("first_date", "last_date").alias("span_days"),
        "active_years", packed(F.col("modes").cast("array<string>")).alias("cluster_modes"), packed("ops").alias("operation_names"),
        "series_group_key", "series_label",
        fn.display_label("series_label", "first_date", "last_date", F.try_element_at("modes", F.lit(1)), "size", "semantic_series_id").alias("series_display_label"),
        packed("crimes").alias("crime_modes"), packed("titles", " || ").alias("sample_titles"),
    )


def component_series(corpus: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments (link, semantic_series_id) and one described series per component.

    ``parts`` is (node, component). Ids follow size, then the smallest link.
    """
    own = corpus.select("link", "titulo", "data_publicacao_dt", "ano", "cluster_id", "nome_operacao", "crime_labels")
    members = cut(parts.select(F.col("node").alias("link"), "component").join(own, "link"))
    described = _described(members, "component", F.count(F.lit(1)))
    described = cut(described.withColumn("series_group_key", fn.series_key("ops", "crimes", "series_label")))
    ids = cut(consecutive_ids(described, "component", -F.col("size"), F.col("component")))
    summary = _layout(described.join(ids, "component"), "semantic_series_id")
    assigned = cut(lookup(members.select("link", "component"), ids, "component").select("link", "semantic_series_id"))
    return assigned, summary


def series_members(assigned: DataFrame, summary: DataFrame, corpus: DataFrame) -> DataFrame:
    """Assignments with the series key and label and the article's own columns.

    A series may hold a large share of all articles, so its facts are looked up, not joined on one hot key.
    """
    meta = summary.select("semantic_series_id", "series_label", "series_group_key")
    own = corpus.select("link", "titulo", "data_publicacao_dt", "ano", "cluster_id", "nome_operacao", "crime_labels")
    return lookup(assigned.select("link", "semantic_series_id"), meta, "semantic_series_id").join(own, "link", "left")


def consolidate(corpus: DataFrame, assigned: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series that share a key become one: metrics over distinct links, new ids by (size, start, label)."""
    members = series_members(assigned, summary, corpus)
    key = F.coalesce("series_group_key", F.lit(""))
    members = cut(members.withColumn("series_group_key", key))
    described = cut(_described(members, "series_group_key", F.count_distinct("link")))
    order = [-F.col("size"), F.coalesce(F.unix_timestamp("first_date"), F.lit(2**62)), F.col("series_label"), F.col("series_group_key")]
    ids = cut(consecutive_ids(described, "series_group_key", *order))
    merged = _layout(described.join(ids, "series_group_key"), "semantic_series_id")
    links = lookup(members.select("link", "series_group_key"), ids, "series_group_key")
    return links.select("link", "semantic_series_id").distinct(), merged.orderBy("semantic_series_id")


def assign_series(corpus: DataFrame, links: DataFrame) -> DataFrame:
    """Corpus with its series id; null where an article is in no series."""
    return corpus.drop("semantic_series_id").join(links.select("link", "semantic_series_id"), "link", "left")
