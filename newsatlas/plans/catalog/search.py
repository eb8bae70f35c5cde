"""Queries over n-gram search, catalog terms and trends (sem_*_index, qry_*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsatlas.operators import corpus as ops, search as se
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query, stage
from newsatlas.plans.catalog.summaries import tagged, trend_sql
from newsatlas.plans.catalog.views import sql


def grams_sql(key: str, text: str, src: str, low: int, high: int) -> str:
    """(key, gram, tf) with every n-gram spelled out."""
    pieces = " UNION ALL ".join(
        f"SELECT {key}, unnest([p[i:i + {n - 1}] for i in range(1, len(p) - {n - 2})]) AS gram, c FROM w WHERE len(p) >= {n}" for n in range(low, high + 1)
    )
    return (
        f"SELECT {key}, gram, sum(c) AS tf FROM (WITH w AS (SELECT {key}, ' ' || word || ' ' AS p, count(*) AS c FROM (SELECT {key}, unnest(string_split_regex({text}, '{v.SP}+')) AS word FROM {src}) "
        f"WHERE word <> '' GROUP BY ALL) {pieces}) GROUP BY ALL"
    )


def index_ctes(prefix: str, key: str, text: str, src: str, low: int, high: int) -> dict:
    p = prefix
    return {
        f"{p}tf": (grams_sql(key, text, src, low, high), [src]),
        f"{p}idf": (f"SELECT gram, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT gram, count(*) AS df FROM {p}tf GROUP BY gram), (SELECT count(*) AS n FROM {src})", [f"{p}tf", src]),
        f"{p}idx": (
            f"SELECT {key}, gram, idf, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, gram, idf, tf * idf AS w FROM {p}tf JOIN {p}idf USING (gram))",
            [f"{p}tf", f"{p}idf"],
        ),
    }


def score_ctes(prefix: str, key: str, query_text: str, low: int, high: int) -> dict:
    p = prefix
    return {
        f"{p}qsrc": (f"SELECT 0 AS one, '{query_text}' AS q", []),
        f"{p}q": (grams_sql("one", "q", f"{p}qsrc", low, high), [f"{p}qsrc"]),
        f"{p}qw": (f"SELECT q.gram, q.tf * i.idf AS q FROM {p}q q JOIN {p}idf i USING (gram)", [f"{p}q", f"{p}idf"]),
        f"{p}score": (
            f"SELECT x.{key}, round(sum(x.weight * y.q) / (SELECT sqrt(sum(q * q)) FROM {p}qw), 6) AS score FROM {p}idx x JOIN {p}qw y USING (gram) GROUP BY 1",
            [f"{p}idx", f"{p}qw"],
        ),
    }


TEXT_CTES = index_ctes("t", "link", "folded", "enr", *se.TEXT_GRAMS)
CRIME_VALUES = {"cvals": ("SELECT DISTINCT l AS value, l AS k FROM (SELECT unnest(crimes) AS l FROM enr)", ["enr"])}
TAG_VALUES = {"gvals": (f"SELECT value, {v.fold('value')} AS k FROM (SELECT DISTINCT trim(unnest(string_split(tags, '|'))) AS value FROM news)", ["news"])}
CATALOG = {**CRIME_VALUES, **index_ctes("c", "value", "k", "cvals", *se.CATALOG_GRAMS)}
TAG_CATALOG = {**TAG_VALUES, **index_ctes("g", "value", "k", "gvals", *se.CATALOG_GRAMS)}


@stage("searched")
def searched(spark, d):
    """What searches by text read of the labelled news."""
    return v.labelled(spark, d).select("link", "ano", "ano_mes", "ufs_mencionadas", "texto_busca_normalizado")


@stage("char_index", write=None)
def text_index(spark, d):
    return se.store_index(searched(spark, d), "link", "texto_busca_normalizado")


@query("sem_char_index", sql("SELECT link, count(*) AS grams, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM tidx GROUP BY link", "tidx", **TEXT_CTES))
def char_index(spark, d):
    rows = text_index(spark, d).rows()
    return rows.groupBy("link").agg(F.count(F.lit(1)).alias("grams"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@query("sem_catalog_index", sql("SELECT value, gram, round(weight, 6) AS weight, round(idf, 6) AS idf FROM gidx", "gidx", **TAG_CATALOG))
def catalog_index(spark, d):
    values = se.catalog_values(tagged(spark, d), "tags_list").withColumn("k", se.fold("value"))
    rows = se.gram_index(values, "value", "k", se.CATALOG_GRAMS)
    return rows.select("value", "gram", F.round("weight", 6).alias("weight"), F.round("idf", 6).alias("idf"))


MISSPELT = "t_shung"


@query("qry_resolve_term", sql("SELECT value AS resolvido, score FROM cscore ORDER BY score DESC, value LIMIT 1", **{**CATALOG, **score_ctes("c", "value", MISSPELT, *se.CATALOG_GRAMS)}))
def resolve_term(spark, d):
    term, score = se.resolve_term(se.catalog_values(v.enriched(spark, d), "crime_labels"), MISSPELT)
    return spark.createDataFrame([(term, score)], "resolvido string, score double")


@query("qry_resolve_tag", sql("SELECT value AS resolvido, score FROM gscore ORDER BY score DESC, value LIMIT 1", **{**TAG_CATALOG, **score_ctes("g", "value", "srcc7", *se.CATALOG_GRAMS)}))
def resolve_tag(spark, d):
    term, score = se.resolve_term(se.catalog_values(tagged(spark, d), "tags_list"), "srcc7")
    return spark.createDataFrame([(term, score)], "resolvido string, score double")


FUZZY = "operacao estrella giua"


@query(
    "qry_fuzzy_text",
    sql(
        "SELECT link, score FROM (SELECT *, count(*) FILTER (score >= 0.20) OVER () AS strong, row_number() OVER (ORDER BY score DESC, link) AS rn FROM tscore) "
        "WHERE CASE WHEN strong < 12 THEN rn <= 150 AND score >= 0.10 ELSE score >= 0.20 END",
        **{**TEXT_CTES, **score_ctes("t", "link", FUZZY, *se.TEXT_GRAMS)},
    ),
)
def fuzzy_text(spark, d):
    return se.fuzzy_text(searched(spark, d), FUZZY, index=text_index(spark, d)).scores


@query("qry_match_signal", sql("SELECT doc_id, 't_schung' AS resolvido FROM enr WHERE list_contains(crimes, 't_schung')", "enr"))
def match_signal(spark, d):
    hit = se.match_signal(v.enriched(spark, d), se.CRIME, MISSPELT)
    return hit.rows.select("doc_id", F.lit(hit.resolved).alias("resolvido"))


@query("qry_match_tag", sql("SELECT doc_id, 'SP' AS resolvido FROM news WHERE list_contains(string_split(tags, ' | '), 'SP')", "news"))
def match_tag(spark, d):
    hit = se.match_signal(tagged(spark, d), se.TAG, "sp")
    return hit.rows.select("doc_id", F.lit(hit.resolved).alias("resolvido"))


@query("qry_match_text", sql("SELECT doc_id, 'Estrela Guia' AS resolvido, CAST(1 AS DOUBLE) AS score FROM enr WHERE contains(folded, 'estrela guia')", "enr"))
def match_text(spark, d):
    hit = se.match_signal(v.enriched(spark, d), se.TEXT, "Estrela Guia")
    return hit.rows.select("doc_id", F.lit(hit.resolved).alias("resolvido"), F.lit(hit.score).alias("score"))


@query(
    "qry_signal_trend",
    sql(
        "SELECT t.ano AS year, t.n AS total_periodo, coalesce(m.c, 0) AS citacoes, 't_schung' AS termo_resolvido, round(coalesce(m.c, 0) / t.n, 6) AS share, "
        "round(coalesce(m.c, 0) / greatest(max(coalesce(m.c, 0)) OVER (), 1) * 100, 6) AS indice FROM (SELECT ano, count(*) AS n FROM enr WHERE ano IS NOT NULL GROUP BY 1) t LEFT JOIN "
        "(SELECT ano, count(*) AS c FROM enr WHERE list_contains(crimes, 't_schung') GROUP BY 1) m USING (ano)",
        "enr",
    ),
)
def signal_trend(spark, d):
    rows = v.enriched(spark, d)
    trend = se.signal_trend(rows, [se.match_signal(rows, se.CRIME, MISSPELT)])
    return trend.select("year", "total_periodo", "citacoes", "termo_resolvido", F.round("share", 6).alias("share"), F.round("indice_google_like", 6).alias("indice"))


@query(
    "qry_dual_compare",
    sql(
        "SELECT 'pico' AS parte, termo AS chave, year AS periodo, citacoes AS a, CAST(0 AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY termo ORDER BY citacoes DESC, year) AS rn "
        f"FROM ({trend_sql('ano', 'year')})) WHERE rn = 1 UNION ALL SELECT 'mapa', uf, 0, coalesce(a.n, 0), coalesce(b.n, 0) FROM "
        "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM enr WHERE contains(folded, 'schung')) GROUP BY uf) a FULL JOIN "
        "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM enr WHERE contains(folded, 'eaux')) GROUP BY uf) b USING (uf)",
        "enr",
    ),
)
def dual_compare(spark, d):
    _, peak, both = se.dual_compare(v.enriched(spark, d), "schung", "eaux")
    return compared(peak, both)


def compared(peak, both):
    peaks = peak.select(F.lit("pico").alias("parte"), F.col("termo").alias("chave"), F.col("pico_periodo").cast("long").alias("periodo"), F.col("pico_citacoes").alias("a"), F.lit(0).cast("long").alias("b"))
    places = both.select(F.lit("mapa").alias("parte"), F.col("uf").alias("chave"), F.lit(0).cast("long").alias("periodo"), F.col("noticias_a").alias("a"), F.col("noticias_b").alias("b"))
    return peaks.unionByName(places)


UF = "SP"
ONE_UF = {"f": (f"SELECT * FROM enr WHERE list_contains(ufs, '{UF}')", ["enr"])}


@query(
    "qry_dual_compare_uf",
    sql(
        "SELECT 'pico' AS parte, termo AS chave, year AS periodo, c AS a, CAST(0 AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY termo ORDER BY c DESC, year) AS rn FROM "
        f"(SELECT ano AS year, termo, count(*) FILTER (list_contains(crimes, label)) AS c FROM f, (VALUES ('{MISSPELT}', 't_schung'), ('t_eaux', 't_eaux')) x(termo, label) WHERE ano IS NOT NULL GROUP BY ALL)) WHERE rn = 1 "
        "UNION ALL SELECT 'mapa', uf, 0, coalesce(a.n, 0), coalesce(b.n, 0) FROM (SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM f WHERE list_contains(crimes, 't_schung')) GROUP BY uf) a FULL JOIN "
        "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM f WHERE list_contains(crimes, 't_eaux')) GROUP BY uf) b USING (uf)",
        "f",
        **ONE_UF,
    ),
)
def dual_compare_uf(spark, d):
    """Two crimes within one state; the misspelt one is resolved from the catalog of all rows."""
    rows = v.enriched(spark, d)
    _, peak, both = se.dual_compare(ops.by_uf(rows, UF), MISSPELT, "t_eaux", se.CRIME, corpus=rows)
    return compared(peak, both)


SCOPED = (
    "SELECT link FROM (SELECT *, count(*) FILTER (score >= 0.20) OVER () AS strong, row_number() OVER (ORDER BY score DESC, link) AS rn FROM tscore SEMI JOIN f USING (link)) "
    "WHERE CASE WHEN strong < 12 THEN rn <= 150 AND score >= 0.10 ELSE score >= 0.20 END"
)


@query(
    "qry_dual_compare_text",
    sql(
        "SELECT 'pico' AS parte, termo AS chave, year AS periodo, c AS a, CAST(0 AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY termo ORDER BY c DESC, year) AS rn FROM "
        f"(SELECT ano AS year, '{FUZZY}' AS termo, count(*) FILTER (link IN (SELECT link FROM near)) AS c FROM f WHERE ano IS NOT NULL GROUP BY ALL UNION ALL "
        "SELECT ano, 'eaux', count(*) FILTER (contains(folded, 'eaux')) FROM f WHERE ano IS NOT NULL GROUP BY ALL)) WHERE rn = 1 "
        "UNION ALL SELECT 'mapa', uf, 0, coalesce(a.n, 0), coalesce(b.n, 0) FROM (SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM f SEMI JOIN near USING (link)) GROUP BY uf) a FULL JOIN "
        "(SELECT uf, count(*) AS n FROM (SELECT unnest(ufs) AS uf FROM f WHERE contains(folded, 'eaux')) GROUP BY uf) b USING (uf)",
        "f",
        "near",
        **{**TEXT_CTES, **score_ctes("t", "link", FUZZY, *se.TEXT_GRAMS), **ONE_UF, "near": (SCOPED, ["tscore", "f"])},
    ),
)
def dual_compare_text(spark, d):
    """Two free texts within one state; the misspelt one is looked up in the stored index of all rows."""
    rows = searched(spark, d)
    _, peak, both = se.dual_compare(ops.by_uf(rows, UF), FUZZY, "eaux", index=text_index(spark, d), corpus=rows)
    return compared(peak, both)
