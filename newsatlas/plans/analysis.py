"""The batch analysis: from index, manifest and bodies to every artifact table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.functions import lexicon
from newsatlas.operators import corpus as ops, graph, neighbours as near, semantic, summaries
from newsatlas.plans.report import report_lines
from newsatlas.session import cut, prepare
from newsatlas.sources import artifacts, schemas, sinks, tables
from newsatlas.sources.schemas import CORPUS_COLUMNS


@dataclass
class Settings:
    neighbours: int = 5
    threshold: float = 0.70
    strict: float = 0.90
    min_gap: int = 30
    seed: int = 42
    candidates: tuple[int, ...] = semantic.CANDIDATES
    sample_starts: int = 10
    final_starts: int = 20
    components: int = 160
    limits: dict = field(default_factory=dict)  # vocabulary limits, as in semantic.vocabulary
    crimes: dict = field(default_factory=lambda: lexicon.CRIMES)
    modus: dict = field(default_factory=lambda: lexicon.MODUS)
    pair_floor: float = 0.80


def load_corpus(index: DataFrame, manifest: DataFrame, bodies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Usable articles with every derived column, materialised once."""
    usable = tables.usable_manifest(manifest, bodies)
    joined = ops.join_corpus(index, usable, require_rows=True).join(bodies, "markdown_path")
    return cut(ops.enrich(ops.parse_dates(joined), settings.crimes, settings.modus))


def cluster(corpus: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(link, vec, cluster_id), and the top terms of each cluster."""
    docs = cut(semantic.tokens(corpus.select("link", "texto_ponderado")).select("link", "terms"))
    model = semantic.fit_tfidf(docs, **settings.limits)
    vectors = model.vectors(docs).select("link", "tfidf")
    reduced = cut(semantic.reduced_vectors(vectors, "link", max_components=settings.components))
    k, _ = semantic.choose_k(reduced, "link", settings.seed, settings.candidates, settings.sample_starts)
    assigned = cut(semantic.assign_clusters(reduced, "link", k, settings.seed, settings.final_starts))
    ids = assigned.select("link", "cluster_id")
    weights = model.rows(docs.join(ids, "link"), "cluster_id")
    sizes = ids.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return assigned, semantic.top_terms(weights, sizes)


def analyse(corpus: DataFrame, assigned: DataFrame, terms: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Every artifact table of the analysis, by name."""
    rows = corpus.drop("cluster_id").join(assigned.select("link", "cluster_id"), "link")
    clusters = cut(summaries.cluster_summary(rows, terms))
    rows = cut(rows.join(F.broadcast(clusters.select("cluster_id", "cluster_label")), "cluster_id", "left"))
    found = near.nearest(assigned.select("link", "vec"), "link", settings.neighbours)
    neighbours = cut(near.neighbour_table(rows, found))
    pairs = cut(near.recurring_pairs(neighbours, settings.threshold, settings.strict, settings.min_gap))
    links, series = graph.consolidate(rows, *graph.component_series(rows, graph.components(pairs)))
    series = cut(series)
    crimes = summaries.labels_by_year(rows, "crime_labels", "crime_label")
    modus = summaries.labels_by_year(rows, "modus_labels", "modus_label")
    temporal = summaries.temporal_recurrence(rows)
    rows = graph.assign_series(rows, cut(links))
    report = report_lines(rows, neighbours, clusters, temporal, crimes, modus, series, settings.pair_floor)
    return {
        "corpus_enriquecido": rows.select(*CORPUS_COLUMNS),
        "vizinhos_semelhantes": neighbours,
        "pares_recorrentes": pairs,
        "resumo_clusters": clusters,
        "recorrencia_temporal": temporal,
        "crimes_por_ano": crimes,
        "modus_operandi_por_ano": modus,
        "series_semanticas": series,
        "clusters_por_ano": summaries.clusters_by_year(rows),
        "estados_por_ano": summaries.states_by(rows, "ano"),
        "estados_por_cluster": summaries.states_by(rows, "cluster_id"),
        "analise_qualitativa": report,
    }


def run(spark: SparkSession, index_path: str, manifest_path: str, bodies_path: str, out: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Read the inputs, analyse them, publish the artifacts as one run, and export its tables as CSV and the report as text."""
    prepare(spark)
    index = tables.load_index(spark, index_path)
    manifest = tables.load_manifest(spark, manifest_path)
    corpus = load_corpus(index.drop("publicado_em"), manifest, tables.read_bodies(spark, bodies_path), settings)
    path = artifacts.publish(analyse(corpus, *cluster(corpus, settings), settings), out)
    written = artifacts.read(spark, out)
    sinks.write_report(written[schemas.REPORT[0]], f"{path}/analise_qualitativa_md")
    sinks.write_csvs({name: written[name] for name in schemas.ARTIFACTS}, f"{path}/csv")
    return written
