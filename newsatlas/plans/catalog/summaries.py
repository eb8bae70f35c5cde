"""Queries over counts, windows, top-k and sets (agg_*, win_*, srt_*, topk_*, set_*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsatlas.functions import gazetteer as geo
from newsatlas.operators import browse, corpus as ops, keys, neighbours as near, search, semantic, summaries as sm
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query
from newsatlas.plans.catalog.views import sql
from newsatlas.plans.catalog.semantic import TERM_CTES, cluster_top_terms

ISO = "'%Y-%m-%d %H:%M:%S'"
YEARLY = "SELECT ano, l AS crime_label, count(*) AS noticias FROM (SELECT ano, unnest(crimes) AS l FROM {src}) WHERE ano IS NOT NULL GROUP BY ALL"
CSY = (
    "SELECT y.ano, y.crime_label, y.uf, g.state, y.noticias FROM (SELECT ano, l AS crime_label, uf, count(*) AS noticias FROM "
    "(SELECT ano, l, unnest(ufs) AS uf FROM (SELECT ano, ufs, unnest(crimes) AS l FROM enr WHERE ano IS NOT NULL)) GROUP BY ALL) y JOIN gaz g USING (uf)"
)
EXTRA = {
    "crimes_year": (YEARLY.format(src="enr"), ["enr"]),
    "csy": (CSY, ["enr", "gaz"]),
    "cmap": ("SELECT crime_label, uf, state, CAST(sum(noticias) AS BIGINT) AS noticias FROM csy WHERE crime_label = 't_eaux' GROUP BY ALL", ["csy"]),
}


def crimes_by_year(spark, d):
    return sm.labels_by_year(v.enriched(spark, d), "crime_labels", "crime_label")


@query("agg_labels_by_year", sql(YEARLY.format(src="enr"), "enr"))
def labels_by_year(spark, d):
    return crimes_by_year(spark, d)


def states_sql(key: str, src: str) -> str:
    return (
        f"SELECT e.{key}, g.uf, g.state, g.lat, g.lon, e.noticias FROM (SELECT {key}, uf, count(*) AS noticias FROM (SELECT {key}, unnest(ufs) AS uf FROM {src} "
        f"WHERE {key} IS NOT NULL) GROUP BY ALL) e JOIN gaz g USING (uf)"
    )


@query("agg_states_by_year", sql(states_sql("ano", "enr"), "enr", "gaz"))
def states_by_year(spark, d):
    return sm.states_by(v.enriched(spark, d), "ano")


@query("agg_states_by_cluster", sql(states_sql("cluster_id", "cor"), "cor", "gaz"))
def states_by_cluster(spark, d):
    return sm.states_by(v.corpus(spark, d), "cluster_id")


@query("agg_clusters_by_year", sql("SELECT ano, cluster_id, cluster_label, count(*) AS noticias FROM cor WHERE ano IS NOT NULL GROUP BY ALL", "cor"))
def clusters_by_year(spark, d):
    return sm.clusters_by_year(v.corpus(spark, d))


def state_year(spark, d):
    return sm.crime_state_year(v.enriched(spark, d))


@query("agg_crime_state_year", sql(CSY, "enr", "gaz"))
def crime_state_year(spark, d):
    return state_year(spark, d)


@query("agg_crime_map", sql("SELECT * FROM cmap", **EXTRA))
def crime_map(spark, d):
    return sm.crime_map(state_year(spark, d), "t_eaux")


@query("agg_crime_map_year", sql("SELECT crime_label, uf, state, noticias FROM csy WHERE crime_label = 't_tion' AND ano = 2015", **EXTRA))
def crime_map_year(spark, d):
    return sm.crime_map(state_year(spark, d), "t_tion", 2015)


@query("agg_map_peak", sql("SELECT state, noticias AS pico, (SELECT CAST(sum(noticias) AS BIGINT) FROM cmap) AS total FROM cmap ORDER BY noticias DESC, uf LIMIT 1", **EXTRA))
def map_peak(spark, d):
    return sm.map_peak(sm.crime_map(state_year(spark, d), "t_eaux"))


@query(
    "agg_states_from_corpus",
    sql(
        "SELECT uf, state, lat, lon, n AS noticias, round(pow(n, 0.7) * 4000, 4) AS radius, round(n / max(n) OVER (), 6) AS share FROM "
        "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM enr) GROUP BY uf) JOIN gaz USING (uf)",
        "enr", "gaz",
    ),
)
def states_from_corpus(spark, d):
    return sm.states_from_corpus(v.enriched(spark, d)).withColumns({"radius": F.round("radius", 4), "share": F.round("share", 6)})


_PACK = "coalesce(array_to_string({0}.vals, '{1}'), '')"
CLUSTER_CTES = {
    **TERM_CTES,
    **v.tops("c_tags", "ctags", "cluster_id", "tag", 8),
    "ctags": (
        f"SELECT cluster_id, tag FROM (SELECT cluster_id, trim(unnest(string_split(tags, '|'))) AS tag FROM cor) WHERE tag <> '' AND {v.fold('tag')} NOT IN {v.words_sql(geo.TAG_KEYS)}",
        ["cor"],
    ),
    **v.tops("c_ufs", "cor", "cluster_id", "unnest(ufs)", 6),
    **v.tops("c_cri", "cor", "cluster_id", "unnest(crimes)", 6),
    **v.tops("c_mod", "cor", "cluster_id", "unnest(modus)", 6),
    **v.titles("c_tit", "cor", "cluster_id"),
    "clusters": (
        "SELECT b.*, " + _PACK.format("tt", " | ") + " AS top_terms, " + _PACK.format("tg", " | ") + " AS top_tags, "
        f"coalesce(array_to_string([{v._STATE_MAP}[u] for u in uf.vals], ' | '), '') AS top_states, " + _PACK.format("cr", " | ") + " AS top_crimes, "
        + _PACK.format("mo", " | ") + " AS top_modus, " + _PACK.format("ti", " || ") + " AS sample_titles, "
        "concat('cluster_', b.cluster_id, '_', " + v.label("coalesce(array_to_string(tt.vals[1:4], ' '), '')") + ") AS cluster_label FROM "
        f"(SELECT cluster_id, count(*) AS size, strftime(min(data_publicacao_dt), {ISO}) AS first_date, strftime(max(data_publicacao_dt), {ISO}) AS last_date, count(DISTINCT ano) AS active_years FROM cor GROUP BY cluster_id) b "
        "LEFT JOIN c_terms tt USING (cluster_id) LEFT JOIN c_tags tg USING (cluster_id) LEFT JOIN c_ufs uf USING (cluster_id) "
        "LEFT JOIN c_cri cr USING (cluster_id) LEFT JOIN c_mod mo USING (cluster_id) LEFT JOIN c_tit ti USING (cluster_id)",
        ["cor", "c_terms", "c_tags", "c_ufs", "c_cri", "c_mod", "c_tit"],
    ),
}


def clusters(spark, d):
    return sm.cluster_summary(v.corpus(spark, d), cluster_top_terms(spark, d))


@query("agg_cluster_summary", sql("SELECT * FROM clusters", **CLUSTER_CTES))
def cluster_summary(spark, d):
    return clusters(spark, d)


GAPS = (
    "SELECT cluster_id, CAST(floor((epoch(data_publicacao_dt) - epoch(lag(data_publicacao_dt) OVER (PARTITION BY cluster_id ORDER BY data_publicacao_dt))) / 86400) AS BIGINT) AS gap "
    "FROM cor WHERE data_publicacao_dt IS NOT NULL"
)
TEMPORAL_CTES = {
    "gaps": (GAPS, ["cor"]),
    "temporal": (
        "SELECT b.*, m.ano_mes AS peak_year_month, m.n AS peak_year_month_count, c.mes AS peak_calendar_month, coalesce(c.n, 0) AS peak_calendar_month_count, "
        "round(c.n / b.noticias, 4) AS peak_calendar_month_share, g.median_gap_days, g.mean_gap_days, b.active_years >= 3 AS repeats_across_years FROM "
        "(SELECT cluster_id, count(*) AS noticias, count(DISTINCT ano) AS active_years, count(DISTINCT ano_mes) AS active_months FROM cor GROUP BY cluster_id) b "
        "LEFT JOIN (SELECT * FROM (SELECT cluster_id, ano_mes, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, ano_mes) AS rn FROM cor GROUP BY cluster_id, ano_mes) WHERE rn = 1) m USING (cluster_id) "
        "LEFT JOIN (SELECT * FROM (SELECT cluster_id, mes, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, mes) AS rn FROM cor WHERE mes IS NOT NULL GROUP BY cluster_id, mes) WHERE rn = 1) c USING (cluster_id) "
        "LEFT JOIN (SELECT cluster_id, round(median(gap), 2) AS median_gap_days, round(avg(gap), 2) AS mean_gap_days FROM gaps WHERE gap IS NOT NULL GROUP BY cluster_id) g USING (cluster_id)",
        ["cor", "gaps"],
    ),
}


@query("agg_temporal", sql("SELECT * FROM temporal", **TEMPORAL_CTES))
def temporal(spark, d):
    return sm.temporal_recurrence(v.corpus(spark, d))


@query("agg_monthly_volume", sql("SELECT ano_mes AS month, count(*) AS noticias FROM enr GROUP BY ALL", "enr"))
def monthly_volume(spark, d):
    return sm.monthly_volume(v.enriched(spark, d))


@query("agg_monthly_volume_cluster", sql("SELECT cluster_id, ano_mes AS month, count(*) AS noticias FROM cor GROUP BY ALL", "cor"))
def monthly_volume_cluster(spark, d):
    return sm.monthly_volume(v.corpus(spark, d), "cluster_id")


@query(
    "agg_monthly_volume_series",
    sql("SELECT semantic_series_id, ano_mes AS month, count(*) AS noticias FROM series_links JOIN cor USING (link) GROUP BY ALL", "series_links", "cor"),
)
def monthly_volume_series(spark, d):
    return sm.monthly_volume(v.corpus_with_series(spark, d).where("semantic_series_id IS NOT NULL"), "semantic_series_id")


@query("agg_label_totals", sql("SELECT crime_label, CAST(sum(noticias) AS BIGINT) AS noticias FROM crimes_year GROUP BY ALL", **EXTRA))
def label_totals(spark, d):
    return sm.label_totals(crimes_by_year(spark, d), "crime_label")


@query(
    "agg_overview",
    sql(
        "SELECT count(*) AS noticias, count(DISTINCT cluster_id) AS clusters, (SELECT count(*) FROM series) AS series, (SELECT count(*) FROM pairs) AS pares, "
        "min(ano) AS ano_min, max(ano) AS ano_max FROM cor",
        "cor", "series", "pairs",
    ),
)
def overview(spark, d):
    return sm.overview(v.corpus(spark, d), v.series(spark, d), v.pairs(spark, d))


@query(
    "agg_series_metrics",
    sql(
        "SELECT count(*) AS total, count(*) FILTER (series_type = 'Com operação nomeada') AS nomeadas, count(*) FILTER (series_type = 'Por crime') AS por_crime, "
        "count(*) FILTER (strength_band = 'Forte') AS fortes FROM ui",
        "ui",
    ),
)
def series_metrics(spark, d):
    return browse.series_metrics(browse.series_catalog(v.series(spark, d)))


@query("agg_catalog_values", sql("SELECT DISTINCT v AS value FROM (SELECT trim(unnest(string_split(tags, '|'))) AS v FROM news) WHERE v <> ''", "news"))
def catalog_values(spark, d):
    return sm.catalog_values(tagged(spark, d), "tags_list")


@query("agg_catalog_crimes", sql("SELECT DISTINCT unnest(crimes) AS value FROM enr", "enr"))
def catalog_crimes(spark, d):
    return sm.catalog_values(v.enriched(spark, d), "crime_labels")


@query("agg_catalog_modus", sql("SELECT DISTINCT unnest(modus) AS value FROM enr", "enr"))
def catalog_modus(spark, d):
    return sm.catalog_values(v.enriched(spark, d), "modus_labels")


def tagged(spark, d):
    return v.enriched(spark, d).withColumn("tags_list", F.split("tags", r" \| "))


# Trends over exact matches: terms taken from the fixture lexicon, so most years have mentions.
TREND_TERMS = ("schung", "eaux")


def trend_sql(period: str, name: str) -> str:
    part = (
        "SELECT t.p AS {n}, t.total_periodo, coalesce(m.c, 0) AS citacoes, '{term}' AS termo FROM "
        "(SELECT {p} AS p, count(*) AS total_periodo FROM enr WHERE {p} IS NOT NULL GROUP BY 1) t LEFT JOIN "
        "(SELECT {p} AS p, count(*) AS c FROM enr WHERE contains(folded, '{term}') GROUP BY 1) m USING (p)"
    )
    return " UNION ALL ".join(part.format(n=name, p=period, term=t) for t in TREND_TERMS)


TREND_SQL = "SELECT *, round(citacoes / total_periodo, 6) AS share, round(citacoes / greatest(max(citacoes) OVER (PARTITION BY termo), 1) * 100, 6) AS indice FROM ({0})"


def trend(spark, d, period=search.YEAR):
    rows = v.enriched(spark, d)
    return search.signal_trend(rows, [search.match_signal(rows, search.TEXT, t) for t in TREND_TERMS], period)


@query("jn_trend", sql(f"SELECT year, total_periodo, citacoes, termo FROM ({trend_sql('ano', 'year')})", "enr"))
def joined_trend(spark, d):
    return trend(spark, d).select("year", "total_periodo", "citacoes", "termo")


@query("win_trend_index", sql(TREND_SQL.format(trend_sql("ano", "year")), "enr"))
def trend_index(spark, d):
    return trend(spark, d).select("year", "total_periodo", "citacoes", "termo", F.round("share", 6).alias("share"), F.round("indice_google_like", 6).alias("indice"))


@query("set_union_rows", sql(TREND_SQL.format(trend_sql("ano_mes", "month")), "enr"))
def union_rows(spark, d):
    return trend(spark, d, search.MONTH).select(
        "month", "total_periodo", "citacoes", "termo", F.round("share", 6).alias("share"), F.round("indice_google_like", 6).alias("indice")
    )


@query(
    "agg_trend_peak",
    sql(
        "SELECT termo, termo AS busca_resolvida, CAST(1 AS DOUBLE) AS score_busca, year AS pico_periodo, citacoes AS pico_citacoes, share AS share_no_pico FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY termo ORDER BY citacoes DESC, year) AS rn FROM ({TREND_SQL.format(trend_sql('ano', 'year'))})) WHERE rn = 1",
        "enr",
    ),
)
def trend_peak(spark, d):
    return search.trend_peak(trend(spark, d)).withColumn("share_no_pico", F.round("share_no_pico", 6))


@query(
    "agg_modes",
    sql(
        "SELECT component, array_to_string(list_sort(list(cluster_id))[1:3], '|') AS modes FROM (SELECT component, cluster_id, rank() OVER (PARTITION BY component ORDER BY count(*) DESC) AS rk "
        "FROM part_rows GROUP BY component, cluster_id) WHERE rk = 1 GROUP BY component",
        "part_rows",
    ),
)
def modes(spark, d):
    rows = v.parts(spark, d).withColumnRenamed("node", "link").join(v.corpus(spark, d).select("link", "cluster_id"), "link")
    return sm.modes(rows, "component", "cluster_id").groupBy("component").agg(keys.ranked_list("cluster_id").alias("modes"))


@query("agg_top_counter", sql("SELECT cluster_id, array_to_string(vals, '|') AS tags FROM c_tags", "c_tags", **CLUSTER_CTES))
def top_counter(spark, d):
    rows = v.corpus(spark, d).select("cluster_id", F.explode(sm.own_tags()).alias("tag"))
    return sm.top_values(rows, "cluster_id", "tag", 8).groupBy("cluster_id").agg(keys.ranked_list("tag").alias("tags"))


# Windows ---------------------------------------------------------------------------------------

@query("win_knn_rank", sql("SELECT s AS source_link, t AS target_link, rnk AS rank FROM knn", "knn"))
def knn_rank(spark, d):
    return v.neighbours(spark, d).select("source_link", "target_link", "rank")


@query("win_gap", sql("SELECT cluster_id, gap AS gap_days, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY ALL", **TEMPORAL_CTES))
def gap(spark, d):
    return sm.gap_counts(v.corpus(spark, d))


@query("win_peak", sql("SELECT cluster_id, peak_year_month AS peak, peak_year_month_count AS peak_count FROM temporal", **TEMPORAL_CTES))
def peak(spark, d):
    return sm.peaks(v.corpus(spark, d), "cluster_id", "ano_mes")


@query("win_dense_id", sql("SELECT semantic_series_id, series_group_key FROM series", "series"))
def dense_id(spark, d):
    return v.series(spark, d).select("semantic_series_id", "series_group_key")


_ORDERS = {
    browse.STRENGTH: "strength_score DESC, size DESC, active_years DESC",
    browse.SIZE: "size DESC, active_years DESC, first_date ASC NULLS LAST",
    browse.SPAN: "active_years DESC, size DESC, first_date ASC NULLS LAST",
    browse.LATEST: "last_date DESC NULLS LAST, size DESC",
}


@query(
    "srt_series",
    sql(
        " UNION ALL ".join(
            f"SELECT '{mode}' AS modo, row_number() OVER (ORDER BY {order}, semantic_series_id) AS pos, semantic_series_id FROM ui" for mode, order in _ORDERS.items()
        ),
        "ui",
    ),
)
def sorted_series(spark, d):
    catalog = browse.series_catalog(v.series(spark, d))
    parts = [
        keys.consecutive_ids(catalog, "semantic_series_id", *browse.sort_keys(mode), out="pos").withColumn("modo", F.lit(mode))
        for mode in _ORDERS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Top-k -----------------------------------------------------------------------------------------

@query(
    "topk_labels",
    sql("SELECT ano, crime_label, noticias FROM crimes_year WHERE crime_label IN (SELECT crime_label FROM crimes_year GROUP BY 1 ORDER BY sum(noticias) DESC, 1 LIMIT 3)", **EXTRA),
)
def top_labels(spark, d):
    return sm.keep_top_labels(crimes_by_year(spark, d), "crime_label", 3).select("ano", "crime_label", "noticias")


@query("topk_crimes", sql("SELECT crime_label, CAST(sum(noticias) AS BIGINT) AS noticias FROM crimes_year GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", **EXTRA))
def top_crimes(spark, d):
    return sm.label_totals(crimes_by_year(spark, d), "crime_label").limit(10)


@query("topk_clusters", sql("SELECT cluster_id, count(*) AS size FROM cor GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", "cor"))
def top_clusters(spark, d):
    return v.corpus(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster_id").limit(12)


@query(
    "topk_state_trend",
    sql(
        "SELECT ano, uf, noticias FROM csy WHERE crime_label = 't_tion' AND uf IN (SELECT uf FROM csy WHERE crime_label = 't_tion' GROUP BY uf ORDER BY sum(noticias) DESC, uf LIMIT 5)",
        **EXTRA,
    ),
)
def state_trend(spark, d):
    return sm.state_trend(state_year(spark, d), "t_tion").select("ano", "uf", "noticias")


@query(
    "topk_examples",
    sql(
        "SELECT label, rn AS rank, link, titulo FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY data_publicacao_dt ASC NULLS LAST, link) AS rn FROM "
        "(SELECT link, titulo, data_publicacao_dt, unnest(crimes) AS label FROM enr)) WHERE rn <= 3",
        "enr",
    ),
)
def examples(spark, d):
    return sm.top_examples(v.enriched(spark, d), "crime_labels").select("label", "rank", "link", "titulo")


@query(
    "topk_pairs",
    sql(
        "SELECT source_link, target_link, cosine_similarity, gap_days FROM (SELECT *, row_number() OVER (PARTITION BY least(source_link, target_link), greatest(source_link, target_link) "
        f"ORDER BY cosine_similarity DESC, gap_days DESC NULLS LAST, source_link) AS pk FROM nb WHERE cosine_similarity >= {v.STRICT}) WHERE pk = 1 "
        "ORDER BY cosine_similarity DESC, gap_days DESC NULLS LAST, source_link, target_link LIMIT 10",
        "nb",
    ),
)
def pairs(spark, d):
    return near.top_pairs(v.neighbours(spark, d), v.STRICT).select("source_link", "target_link", "cosine_similarity", "gap_days")


@query("topk_recurring_clusters", sql("SELECT cluster_id, noticias, active_years FROM temporal WHERE repeats_across_years ORDER BY noticias DESC, cluster_id LIMIT 10", **TEMPORAL_CTES))
def recurring_clusters(spark, d):
    return sm.recurring_clusters(sm.temporal_recurrence(v.corpus(spark, d))).select("cluster_id", "noticias", "active_years")


_ANCHOR = "https://example.org/noticias/7"


@query(
    "topk_neighbors_of",
    sql(
        f"SELECT source_link, target_link, cosine_similarity, gap_days FROM nb WHERE source_link = '{_ANCHOR}' OR target_link = '{_ANCHOR}' "
        "ORDER BY cosine_similarity DESC, gap_days DESC NULLS LAST, source_link, target_link LIMIT 20",
        "nb",
    ),
)
def neighbours_of(spark, d):
    return near.pairs_of(v.neighbours(spark, d), _ANCHOR).select("source_link", "target_link", "cosine_similarity", "gap_days")


@query("topk_recent", sql(f"SELECT link, strftime(data_publicacao_dt, {ISO}) AS ts, titulo FROM cor WHERE cluster_id = 2 ORDER BY data_publicacao_dt DESC NULLS LAST, link LIMIT 30", "cor"))
def recent(spark, d):
    rows = v.corpus(spark, d).where("cluster_id = 2")
    return sm.recent(rows, 30).select("link", F.col("data_publicacao_dt").alias("ts"), "titulo")


# Sets ------------------------------------------------------------------------------------------

@query("set_dedup_pair", sql("SELECT source_link, target_link FROM (SELECT *, row_number() OVER (PARTITION BY least(source_link, target_link), greatest(source_link, target_link) ORDER BY cosine_similarity DESC, gap_days DESC NULLS LAST, source_link) AS pk FROM nb) WHERE pk = 1", "nb"))
def dedup_pair(spark, d):
    return near.unique_pairs(v.neighbours(spark, d)).select("source_link", "target_link")


@query("set_distinct_labels", sql("SELECT DISTINCT l AS label FROM (SELECT unnest(crimes) AS l FROM enr UNION ALL SELECT unnest(modus) FROM enr)", "enr"))
def distinct_labels(spark, d):
    rows = v.enriched(spark, d)
    return rows.select(F.explode("crime_labels").alias("label")).union(rows.select(F.explode("modus_labels"))).distinct()


@query("set_geo_exclusion", sql("SELECT tag, count(*) AS n FROM ctags GROUP BY tag", "ctags", **CLUSTER_CTES))
def geo_exclusion(spark, d):
    return v.corpus(spark, d).select(F.explode(sm.own_tags()).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("set_row_labels", sql("SELECT doc_id, array_to_string(ufs, '|') AS labels FROM enr", "enr"))
def row_labels(spark, d):
    """The states of a row: the union of what tags, headline and dateline name."""
    sources = geo.mention_sources("titulo", "subtitulo", "tags", "markdown_text").alias("m")
    found = v.news(spark, d).select("doc_id", sources).select("doc_id", geo.state_evidence("m").alias("e"))
    return found.select("doc_id", F.array_sort(F.array_union(F.array_union("e.tags", "e.headline"), F.col("e.dateline"))).alias("labels"))
