"""Queries over projections, row filters and joins (prj_*, flt_*, jn_*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsatlas.functions import gazetteer as geo, text
from newsatlas.operators import corpus as ops, graph, ingest, keys, neighbours as near, summaries as sm
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query
from newsatlas.plans.catalog.views import sql
from newsatlas.sources import tables

ISO = "'%Y-%m-%d %H:%M:%S'"


@query("prj_search_text", sql("SELECT doc_id, texto_busca, md5(folded) AS folded FROM txt", "txt"))
def search_text(spark, d):
    return ops.with_text(v.news(spark, d)).select("doc_id", "texto_busca", F.md5("texto_busca_normalizado").alias("folded"))


@query("prj_weighted_text", sql("SELECT doc_id, ponderado FROM weighted", "weighted"))
def weighted_text(spark, d):
    return ops.with_text(v.news(spark, d)).select("doc_id", F.col("texto_ponderado").alias("ponderado"))


@query("prj_dates", sql(f"SELECT doc_id, strftime(data_publicacao_dt, {ISO}) AS ts, ano, mes, ano_mes FROM enr", "enr"))
def dates(spark, d):
    return v.enriched(spark, d).select("doc_id", F.col("data_publicacao_dt").alias("ts"), "ano", "mes", "ano_mes")


@query("flt_state", sql("SELECT doc_id FROM enr WHERE list_contains(ufs, 'MT')", "enr"))
def state(spark, d):
    return ops.by_state(v.enriched(spark, d), "Mato Grosso").select("doc_id")


@query("flt_uf", sql("SELECT doc_id FROM enr WHERE list_contains(ufs, 'SP')", "enr"))
def uf(spark, d):
    return ops.by_uf(v.enriched(spark, d), "SP").select("doc_id")


@query("flt_label", sql("SELECT doc_id FROM enr WHERE list_contains(crimes, 't_schung')", "enr"))
def label(spark, d):
    return ops.by_label(v.enriched(spark, d), "crime_labels", "t_schung").select("doc_id")


@query("flt_regex", sql("SELECT doc_id, titulo FROM news WHERE regexp_matches(titulo, '(?i)opera.*(aurora|farol)')", "news"))
def regex(spark, d):
    return ops.by_pattern(v.news(spark, d), "opera.*(AURORA|farol)", "titulo").select("doc_id", "titulo")


@query("flt_cluster", sql("SELECT link, titulo FROM cor WHERE cluster_id = 3", "cor"))
def cluster(spark, d):
    return ops.of_cluster(v.corpus(spark, d), 3).select("link", "titulo")


@query("flt_series", sql("SELECT link, titulo FROM series_links JOIN cor USING (link) WHERE semantic_series_id = 1", "series_links", "cor"))
def series(spark, d):
    return ops.of_series(v.corpus_with_series(spark, d), 1).select("link", "titulo")


_REC = (
    f"coalesce(gap_days, 0) >= 30 AND same_cluster AND (cosine_similarity >= {v.STRICT} OR (coalesce(source_operation_name, '') <> '' "
    f"AND coalesce(source_operation_name = target_operation_name, false) AND cosine_similarity >= {v.THRESHOLD}))"
)


@query("flt_gap_recurrence", sql(f"SELECT source_link, target_link, coalesce({_REC}, false) AS recorrente FROM nb", "nb"))
def gap_recurrence(spark, d):
    return v.neighbours(spark, d).select("source_link", "target_link", near.recurs(v.THRESHOLD, v.STRICT).alias("recorrente"))


@query(
    "prj_has_series",
    sql("SELECT c.link, s.semantic_series_id IS NOT NULL AS has_series FROM cor c LEFT JOIN series_links s USING (link)", "series_links", "cor"),
)
def has_series(spark, d):
    return tables.reload_corpus(v.corpus_with_series(spark, d)).select("link", "has_series")


# Some labels are blanked, so that every step of the fallback is taken.
_BLANK = (
    "SELECT semantic_series_id, CASE WHEN semantic_series_id % 4 = 0 THEN NULL ELSE series_label END AS series_label, "
    "CASE WHEN semantic_series_id % 8 = 0 OR operation_names = '' THEN NULL ELSE operation_names END AS operation_names, "
    "nullif(crime_modes, '') AS crime_modes, sample_titles, series_group_key, first_date, last_date, cluster_modes, size FROM {series} s"
)


@query(
    "prj_series_defaults",
    sql(
        "SELECT semantic_series_id, coalesce(series_label, operation_names, crime_modes, sample_titles, 'serie_sem_nome') AS series_label, "
        f"coalesce(operation_names, '') AS operation_names FROM ({_BLANK.replace('{series}', 'series')})",
        "series",
    ),
)
def series_defaults(spark, d):
    blanked = spark.sql(_BLANK, series=v.series(spark, d))
    return tables.reload_series(blanked).select("semantic_series_id", "series_label", "operation_names")


@query(
    "prj_excerpt",
    sql("SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'Conteúdo markdown não encontrado.' ELSE left(markdown_text, 6000) || CASE WHEN length(markdown_text) > 6000 THEN '...' ELSE '' END END AS trecho FROM news", "news"),
)
def excerpt(spark, d):
    body = F.when(F.col("doc_id") % 19 != 0, F.col("markdown_text"))
    return v.news(spark, d).select("doc_id", text.excerpt(body).alias("trecho"))


def indexed(spark, d):
    return ingest.prepare_index(v.idx(spark, d))


def recorded(spark, d):
    done = ingest.prepare_manifest(v.manifest(spark, d)).where("trim(markdown_path) <> ''")
    return tables.usable_manifest(done, v.bodies(spark, d))


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY seq DESC) AS rn FROM manifest) WHERE rn = 1)"
_FIRST = rf"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lnk ORDER BY seq) AS rn FROM (SELECT *, nullif({v.strip('link')}, '') AS lnk FROM idx)) WHERE rn = 1 AND lnk IS NOT NULL)"


@query(
    "jn_corpus",
    sql(
        f"SELECT i.lnk AS link, i.titulo, m.markdown_path FROM {_FIRST} i JOIN {_LAST} m ON m.link = i.lnk WHERE m.status = 'ok' AND trim(m.markdown_path) <> '' "
        "AND m.markdown_path IN (SELECT markdown_path FROM bodies)",
        "idx", "manifest", "bodies",
    ),
)
def join_corpus(spark, d):
    rows = ops.join_corpus(indexed(spark, d).drop("seq"), recorded(spark, d).drop("seq"), require_rows=True)
    return rows.select("link", "titulo", "markdown_path")


@query("jn_cluster_label", sql("SELECT link, cluster_label FROM cor", "cor"))
def cluster_label(spark, d):
    names = v.table(spark, d, "embeddings").select(F.col("label").alias("cluster_id")).distinct()
    names = names.withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")))
    rows = v.corpus(spark, d).select("link", "cluster_id")
    return rows.join(F.broadcast(names), "cluster_id", "left").select("link", "cluster_label")  # one row per cluster


@query("jn_series_assign", sql("SELECT c.link, s.semantic_series_id FROM cor c LEFT JOIN series_links s USING (link)", "series_links", "cor"))
def series_assign(spark, d):
    return v.corpus_with_series(spark, d).select("link", "semantic_series_id")


@query(
    "jn_series_members",
    sql("SELECT link, part_id AS semantic_series_id, part_label AS series_label, series_group_key, titulo, ano, cluster_id, nome_operacao, array_to_string(crimes, '|') AS crime_labels FROM key_rows", "key_rows"),
)
def series_members(spark, d):
    rows = graph.series_members(v.first_links(spark, d), v.first_series(spark, d), v.corpus(spark, d))
    return rows.select("link", "semantic_series_id", "series_label", "series_group_key", "titulo", "ano", "cluster_id", "nome_operacao", "crime_labels")


@query("jn_gazetteer", sql("SELECT e.doc_id, g.uf, g.state, g.lat, g.lon FROM (SELECT doc_id, unnest(ufs) AS uf FROM enr) e JOIN gaz g USING (uf)", "enr", "gaz"))
def gazetteer(spark, d):
    rows = v.enriched(spark, d).select("doc_id", F.explode("ufs_mencionadas").alias("uf"))
    return rows.join(F.broadcast(geo.gazetteer(spark)), "uf").select("doc_id", "uf", "state", "lat", "lon")


_UFC = "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM enr WHERE list_contains(crimes, 't_eaux')) GROUP BY uf)"


@query(
    "jn_geo_polygons",
    sql(
        "SELECT p.uf, 'polygon-' || p.uf AS geometry, coalesce(c.n, 0) AS noticias, round(coalesce(c.n, 0) / greatest(max(coalesce(c.n, 0)) OVER (), 1), 6) AS ratio "
        f"FROM (SELECT uf FROM gaz UNION ALL SELECT 'XX') p LEFT JOIN {_UFC} c USING (uf)",
        "enr", "gaz",
    ),
)
def geo_polygons(spark, d):
    shapes = geo.gazetteer(spark).select("uf").union(spark.range(1).select(F.lit("XX")))
    shapes = shapes.withColumn("geometry", F.concat(F.lit("polygon-"), F.col("uf")))
    counts = sm.states_from_corpus(ops.by_label(v.enriched(spark, d), "crime_labels", "t_eaux"))
    return sm.paint_polygons(shapes, counts).select("uf", "geometry", "noticias", F.round("ratio", 6).alias("ratio"))


def count_sql(label: str) -> str:
    return f"(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM enr WHERE list_contains(crimes, '{label}')) GROUP BY uf)"


@query(
    "jn_dual_map",
    sql(
        "SELECT uf, state, lat, lon, noticias_a, noticias_b, noticias_a + noticias_b AS total, round(pow(noticias_a / pk, 0.72) * 240000, 4) AS radius_a, "
        "round(pow(noticias_b / pk, 0.72) * 240000, 4) AS radius_b FROM (SELECT *, greatest(max(noticias_a) OVER (), max(noticias_b) OVER (), 1) AS pk FROM ("
        f"SELECT uf, coalesce(a.n, 0) AS noticias_a, coalesce(b.n, 0) AS noticias_b FROM {count_sql('t_schung')} a FULL JOIN {count_sql('t_eaux')} b USING (uf)) JOIN gaz USING (uf))",
        "enr", "gaz",
    ),
)
def dual_map(spark, d):
    rows = v.enriched(spark, d)
    both = sm.dual_map(ops.by_label(rows, "crime_labels", "t_schung"), ops.by_label(rows, "crime_labels", "t_eaux"))
    return both.withColumns({"radius_a": F.round("radius_a", 4), "radius_b": F.round("radius_b", 4)})


@query("jn_similarity", sql("SELECT s AS source, t AS target, rnk AS rank, sim AS cosine_similarity FROM knn", "knn"))
def similarity(spark, d):
    vectors = v.table(spark, d, "embeddings").join(v.news(spark, d).select("doc_id", "link"), F.col("vec_id") == F.col("doc_id"))
    return near.nearest(vectors.select("link", F.col("embedding").alias("vec")), "link", 5)


_ANCHOR = "https://example.org/noticias/7"


@query("jn_pair_lookup", sql(f"SELECT source_link, target_link, cosine_similarity FROM nb WHERE source_link = '{_ANCHOR}' OR target_link = '{_ANCHOR}'", "nb"))
def pair_lookup(spark, d):
    rows = v.neighbours(spark, d).where((F.col("source_link") == _ANCHOR) | (F.col("target_link") == _ANCHOR))
    return rows.select("source_link", "target_link", "cosine_similarity")


@query(
    "jn_lexicon",
    sql(
        "SELECT e.doc_id, l.taxonomy, l.label, l.keyword FROM (SELECT doc_id, folded FROM enr) e, (VALUES "
        + ", ".join(f"('{t}', {v.q(l)}, {v.q(k)})" for t, r in (("crime", v.CRIMES), ("modus", v.MODUS)) for l, ks in r.items() for k in ks)
        + ") l(taxonomy, label, keyword) WHERE contains(e.folded, l.keyword)",
        "enr",
    ),
)
def lexicon(spark, d):
    return keyword_hits(v.enriched(spark, d))


def keyword_hits(rows):
    """One row per article and keyword that occurs in it: one projection, not a join."""
    text_ = F.col("texto_busca_normalizado")
    cells = [
        F.when(F.contains(text_, F.lit(k)), F.struct(F.lit(t).alias("taxonomy"), F.lit(l).alias("label"), F.lit(k).alias("keyword")))
        for t, rules in (("crime", v.CRIMES), ("modus", v.MODUS)) for l, ks in rules.items() for k in ks
    ]
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*cells))))
