"""Queries over single column functions (fn_*) and row projections of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsatlas.functions import dates, labels, links, series as fs, text
from newsatlas.functions import gazetteer as geo
from newsatlas.operators import corpus as ops
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query
from newsatlas.plans.catalog.views import sql

ISO = "'%Y-%m-%d %H:%M:%S'"


@query("fn_clean_text", f"SELECT conv_id, turn, nullif({v.collapse('text')}, '') AS cleaned FROM conversations")
def clean_text(spark, d):
    return v.table(spark, d, "conversations").select("conv_id", "turn", text.clean_text("text").alias("cleaned"))


@query("fn_normalize_link", sql(f"SELECT seq, nullif({v.strip('link')}, '') AS link FROM idx", "idx"))
def normalize_link(spark, d):
    return v.idx(spark, d).select("seq", links.normalize_link("link").alias("link"))


# Bylines and headers are written from the publication date of each article; some are left irregular.
BYLINE = (
    "CASE WHEN doc_id % 23 = 0 THEN 'sem data' WHEN doc_id % 29 = 0 THEN NULL "
    "ELSE concat('  por Equipe  publicado ', {d}, '  ', {t}, ' Notícia ') END"
)
HEADER = (
    "CASE WHEN doc_id % 23 = 0 THEN 'sem data' ELSE concat('Publicado em ', {d}, ' ', {t}, "
    "CASE WHEN doc_id % 4 = 0 THEN concat('  Atualizado em ', {d}, ' ', {t}) ELSE '' END) END"
)
SPARK_DT = {"d": "date_format(pub_ts, 'dd/MM/yyyy')", "t": "date_format(pub_ts, \"HH'h'mm\")"}
DUCK_DT = {"d": "strftime(pub_ts, '%d/%m/%Y')", "t": "strftime(pub_ts, '%Hh%M')"}


def stamped(spark, d, template, name):
    return v.news(spark, d).where("pub_ts IS NOT NULL").select("doc_id", F.expr(template.format(**SPARK_DT)).alias(name))


def stamped_sql(template, name):
    return f"(SELECT doc_id, {template.format(**DUCK_DT)} AS {name} FROM news WHERE pub_ts IS NOT NULL)"


_PUB = r"(?i)publicado\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}h\d{2})\s+(\S+)"


@query(
    "fn_parse_published",
    sql(
        f"SELECT doc_id, CASE WHEN regexp_matches(x, '{_PUB}') THEN regexp_extract(x, '{_PUB}', 1) || ' ' || regexp_extract(x, '{_PUB}', 2) ELSE x END AS publicado_em, "
        f"CASE WHEN regexp_matches(x, '{_PUB}') THEN regexp_extract(x, '{_PUB}', 1) END AS data_publicacao, "
        f"CASE WHEN regexp_matches(x, '{_PUB}') THEN regexp_extract(x, '{_PUB}', 2) END AS hora_publicacao "
        f"FROM (SELECT doc_id, nullif({v.collapse('byline')}, '') AS x FROM {stamped_sql(BYLINE, 'byline')})",
        "news",
    ),
)
def parse_published(spark, d):
    rows = stamped(spark, d, BYLINE, "byline").withColumn("p", dates.parse_byline("byline"))
    return rows.select("doc_id", "p.publicado_em", "p.data_publicacao", "p.hora_publicacao")


_STAMP = r"(\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2})"
_ART = rf"(?i)Publicado em\s+{_STAMP}(?:\s+Atualizado em\s+{_STAMP})?"


@query(
    "fn_parse_article_dates",
    sql(
        f"SELECT doc_id, nullif(regexp_extract(x, '{_ART}', 1), '') AS published_at, nullif(regexp_extract(x, '{_ART}', 2), '') AS updated_at "
        f"FROM (SELECT doc_id, {v.collapse('header')} AS x FROM {stamped_sql(HEADER, 'header')})",
        "news",
    ),
)
def parse_article_dates(spark, d):
    rows = stamped(spark, d, HEADER, "header").withColumn("p", dates.parse_article_dates("header"))
    return rows.select("doc_id", "p.published_at", "p.updated_at")


@query(
    "fn_content_type",
    sql(f"SELECT doc_id, string_split(nullif({v.collapse('byline')}, ''), ' ')[-1] AS tipo FROM {stamped_sql(BYLINE, 'byline')}", "news"),
)
def content_type(spark, d):
    return stamped(spark, d, BYLINE, "byline").select("doc_id", dates.content_type("byline").alias("tipo"))


@query("fn_page_number", "SELECT page_id, CAST(page_id * 60 // 60 + 1 AS BIGINT) AS page_number, CAST(page_id * 7 // 60 + 1 AS BIGINT) AS odd_page FROM pages")
def page_number(spark, d):
    return v.table(spark, d, "pages").select(
        "page_id", links.page_number(F.col("page_id") * 60).alias("page_number"), links.page_number(F.col("page_id") * 7).alias("odd_page")
    )


@query(
    "fn_tags_pack",
    sql(
        "SELECT doc_id, array_to_string(t, ' | ') AS tags, CAST(len(t) AS BIGINT) AS total_tags FROM (SELECT doc_id, "
        f"[x for x in [nullif({v.collapse('y')}, '') for y in string_split(concat(tags, ' |  | ', coalesce(subtitulo, '')), '|')] if x IS NOT NULL] AS t FROM news)",
        "news",
    ),
)
def tags_pack(spark, d):
    raw = F.split(F.concat("tags", F.lit(" |  | "), F.coalesce("subtitulo", F.lit(""))), r"\|")
    rows = v.news(spark, d).withColumn("t", links.keep_tags(raw))
    return rows.select("doc_id", text.pack_list("t").alias("tags"), F.size("t").alias("total_tags"))


@query("fn_slug", f"SELECT page_id, {v.slug_name('url')} AS slug FROM pages")
def slug(spark, d):
    return v.table(spark, d, "pages").select("page_id", links.slug("url").alias("slug"))


@query("fn_filename", f"SELECT page_id, {v.file_name_sql('url')} AS name FROM pages")
def filename(spark, d):
    return v.table(spark, d, "pages").select("page_id", links.file_name("url").alias("name"))


@query(
    "fn_html_escape",
    "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages",
)
def html_escape(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.md5(text.html_escape("html")).alias("escaped"))


@query("fn_strip_markdown", f"SELECT doc_id, {v.clean_md('text')} AS clean FROM documents")
def strip_markdown(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.strip_markdown("text").alias("clean"))


@query("fn_fold", f"SELECT doc_id, {v.fold('text')} AS folded FROM documents")
def fold(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.fold("text").alias("folded"))


@query("fn_normalize_label", sql(f"SELECT doc_id, {v.label('titulo')} AS a, {v.label('''coalesce(subtitulo, '')''')} AS b FROM news", "news"))
def normalize_label(spark, d):
    return v.news(spark, d).select(
        "doc_id", text.normalize_label("titulo").alias("a"), text.normalize_label(F.coalesce("subtitulo", F.lit(""))).alias("b")
    )


@query("fn_semantic_preprocess", sql(f"SELECT doc_id, {v.without_geo('markdown_text')} AS t FROM news", "news"))
def semantic_preprocess(spark, d):
    return v.news(spark, d).select("doc_id", geo.without_geography("markdown_text").alias("t"))


@query(
    "fn_parse_datetime",
    sql(
        f"SELECT doc_id, strftime(pub_ts, {ISO}) AS ts, CAST(NULL AS VARCHAR) AS bad FROM (SELECT doc_id, date_trunc('minute', pub_ts) AS pub_ts FROM news)",
        "news",
    ),
)
def parse_datetime(spark, d):
    raw = F.concat(F.lit(" "), F.date_format("pub_ts", "dd/MM/yyyy HH'h'mm"), F.lit(" "))
    bad = F.concat(F.lit("31/02/"), F.year("pub_ts").cast("string"), F.lit(" 09h15"))
    return v.news(spark, d).select(
        "doc_id", dates.parse_datetime(raw).alias("ts"), dates.parse_datetime(bad).alias("bad")
    )


@query("fn_operation_name", sql("SELECT doc_id, nome_operacao FROM ops", "ops"))
def operation_name(spark, d):
    return v.news(spark, d).select("doc_id", labels.operation_name("titulo").alias("nome_operacao"))


@query("fn_keyword_labels", sql("SELECT doc_id, array_to_string(crimes, '|') AS crimes, array_to_string(modus, '|') AS modus FROM enr", "enr"))
def keyword_labels(spark, d):
    return v.enriched(spark, d).select("doc_id", F.col("crime_labels").alias("crimes"), F.col("modus_labels").alias("modus"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WIDE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_bool_or(list_transform((SELECT list(DISTINCT w) FROM wide WHERE w[1] = '{c}'), lambda k: contains(folded, k))) THEN 'k_{c}' END" for c in LETTERS) + "], lambda x: x IS NOT NULL), '|')"


@query(
    "fn_keyword_labels_wide",
    sql(f"SELECT doc_id, {_WIDE} AS labels FROM enr", "enr", "wide", wide=("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark", [])),
)
def keyword_labels_wide(spark, d):
    """A lexicon of some thousand keywords: the words of the benchmark, labelled by their first letter."""
    words = v.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w")).distinct()
    rules = {f"k_{c}": [] for c in LETTERS}
    for r in words.orderBy("w").collect():  # the benchmark is the lexicon here
        rules[f"k_{r['w'][0]}"].append(r["w"])
    return v.enriched(spark, d).select("doc_id", labels.keyword_labels("texto_busca_normalizado", rules).alias("labels"))



@query("fn_state_mentions", sql("SELECT doc_id, array_to_string(ufs, '|') AS ufs FROM enr", "enr"))
def state_mentions(spark, d):
    return ops.with_states(v.news(spark, d)).select("doc_id", F.col("ufs_mencionadas").alias("ufs"))


@query("prj_state_names", sql(f"SELECT doc_id, array_to_string([{v._STATE_MAP}[u] for u in ufs], '|') AS estados FROM enr", "enr"))
def state_names(spark, d):
    return v.enriched(spark, d).select("doc_id", F.col("estados_mencionados").alias("estados"))


@query(
    "fn_pretty_label",
    "SELECT p_partkey, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(replace(lower(p_type), '_', ' '), ' ')], ' ') AS pretty FROM part",
)
def pretty_label(spark, d):
    return v.table(spark, d, "part").select("p_partkey", text.pretty_label(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("pretty"))


@query("fn_gap_days", sql("SELECT source_link, target_link, gap_days FROM nb", "nb"))
def gap_days(spark, d):
    return v.neighbours(spark, d).select("source_link", "target_link", dates.gap_days("source_data", "target_data").alias("gap_days"))


@query(
    "fn_round",
    "SELECT event_id, round(value / 7, 6) AS r6, round(value / 7, 4) AS r4, round(value / 7, 2) AS r2 FROM events",
)
def rounded(spark, d):
    x = F.col("value") / 7
    return v.table(spark, d, "events").select("event_id", F.round(x, 6).alias("r6"), F.round(x, 4).alias("r4"), F.round(x, 2).alias("r2"))


@query(
    "fn_list_cell",
    sql("SELECT doc_id, array_to_string([trim(x) for x in string_split(tags, '|')], '|') AS tags, array_to_string(crimes, '|') AS crimes FROM enr", "enr"),
)
def list_cell(spark, d):
    quoted = F.concat(F.lit("['"), F.array_join("crime_labels", "', '"), F.lit("']"))
    stored = F.when(F.size("crime_labels") > 0, quoted).otherwise(F.lit("[]"))
    return v.enriched(spark, d).select("doc_id", text.unpack_list("tags").alias("tags"), text.unpack_list(stored).alias("crimes"))


def described(spark, d):
    return v.series(spark, d)


@query("fn_series_label", sql("SELECT semantic_series_id, series_label FROM series", "series"))
def series_label(spark, d):
    return described(spark, d).select("semantic_series_id", "series_label")


@query("fn_series_key", sql("SELECT semantic_series_id, series_group_key FROM first_series", "first_series"))
def series_key(spark, d):
    return v.first_series(spark, d).select("semantic_series_id", "series_group_key")


@query("fn_series_display", sql("SELECT semantic_series_id, series_display_label FROM series", "series"))
def series_display(spark, d):
    return described(spark, d).select("semantic_series_id", "series_display_label")


@query("fn_series_ui_label", sql("SELECT semantic_series_id, series_ui_label FROM ui", "ui"))
def series_ui_label(spark, d):
    return described(spark, d).select("semantic_series_id", fs.ui_label().alias("series_ui_label"))


@query("fn_series_type", sql("SELECT semantic_series_id, series_type FROM ui", "ui"))
def series_type(spark, d):
    return described(spark, d).select("semantic_series_id", fs.series_type().alias("series_type"))


@query("fn_series_strength", sql("SELECT semantic_series_id, strength_band FROM ui", "ui"))
def series_strength(spark, d):
    return described(spark, d).select("semantic_series_id", fs.series_strength().alias("strength_band"))
