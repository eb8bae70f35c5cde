"""Queries over readers, HTML extraction and writers (src_*, snk_*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from newsatlas.functions import gazetteer as geo, lexicon as lx
from newsatlas.operators import ingest
from newsatlas.plans import analysis
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query, stage
from newsatlas.plans.catalog.rows import keyword_hits
from newsatlas.plans.catalog.views import sql
from newsatlas.session import scratch_dir
from newsatlas.sources import artifacts, body_store, html, schemas, sinks, tables

# Selectors that fit the given pages.
ARTICLE = html.ArticleRules(
    container="article", body="", title="h1", section="", category="", subtitle="", dates="", tags="",
    drop=("script", "style", "nav", "div.ad"),
)
LISTING = html.ListingRules(item="nav li", title="a", category="", summary="", byline="", tags="")

_WORDS = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"
_BARE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


def words_sql(x: str) -> str:
    return _BARE.format(x=_WORDS.replace("{x}", x))


def pages(spark, d):
    """Pages; one in ten has lost its heading."""
    bare = F.when(F.col("page_id") % 10 == 0, F.regexp_replace("html", "(?s)<h1>.*?</h1>", "")).otherwise(F.col("html"))
    return v.table(spark, d, "pages").withColumn("html", bare)


PAGES_SQL = "SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN regexp_replace(html, '(?s)<h1>.*?</h1>', '', 'g') ELSE html END AS html FROM pages"
ART_SQL = (
    "SELECT page_id, url, CASE WHEN contains(html, '<h1>') THEN " + words_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + " END AS title, "
    "CASE WHEN contains(html, '<h1>') THEN " + words_sql("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)") + " END AS body, "
    "CASE WHEN NOT contains(html, '<h1>') THEN 'no ''h1'' in the page' END AS error FROM pgs"
)
EXTRA = {"pgs": (PAGES_SQL, []), "art": (ART_SQL, ["pgs"])}

# The given pages in the default markup: title, paragraphs and menu of each page stand in other nodes, lists and tables.
DATED = "Publicado em 01/02/2024 09h15"
UPDATED = " Atualizado em 02/03/2024  10h00"


def dressed_pages(spark, d):
    """Pages as the default rules expect them; one in ten has no heading, one in fifteen no body."""
    own = v.table(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("title"),
        F.regexp_extract("html", "(?s)</h1>(.*?)</article>", 1).alias("paragraphs"), F.regexp_extract("html", "(?s)<nav><ul>(.*?)</ul></nav>", 1).alias("menu"),
    )
    number = F.col("page_id")
    heading = F.when(number % 10 == 0, F.lit("")).otherwise(F.concat(F.lit('<h1 class="big documentFirstHeading">'), "title", F.lit("</h1>")))
    dated = F.when(number % 7 == 0, F.lit("sem data")).when(number % 2 == 0, F.lit(DATED + UPDATED)).otherwise(F.lit(DATED))
    html_text = F.concat(
        F.lit('<html><body><div id="content"><div class="column"><a>Seção '), number, F.lit("</a> <a> </a><a>Tema<b>  dois</b></a></div><article><p class=\"section\">Notícias "), number % 3,
        F.lit('</p><p class="nitfSubtitle"> Operação</p>'), heading, F.lit('<div class="documentDescription">Linha\nfina &amp; curta</div><div class="viewlet-above-content-body"> '), dated,
        F.lit('</div><div id="'), F.when(number % 15 == 7, F.lit("other")).otherwise(F.lit("content-core")), F.lit('"><script>x("<p>")</script><h2>Texto</h2>'), "paragraphs",
        F.lit('<div class="visualClear">fora</div><h3>Leia</h3><ul><li>Mais notícias<ul>'), "menu", F.lit("</ul><li>Fim</ul><ol><li>um<li>dois</ol><blockquote>Fonte <br> PF</blockquote>"),
        F.lit("<table><tr><th>Campo<th>Valor</tr><tr><td>página<td>"), number, F.lit('<tr><td>endereço<td><a href="'), "url", F.lit('">aqui</a></table><div class="documentActions">fora</div></div></article></div></body></html>'),
    )
    return own.select("page_id", "url", html_text.alias("html"))


_ITEM = "'    - [' || " + words_sql("regexp_extract(x, '>([^<]*)</a>', 1)") + " || '](' || regexp_extract(x, 'href=\"([^\"]*)\"', 1) || ')'"
_BODY = (
    "concat_ws(chr(10) || chr(10), '## Texto', nullif(array_to_string(list_filter(list_transform(string_split(paragraphs, '<p>'), lambda x: " + words_sql("x")
    + "), lambda x: x <> ''), chr(10) || chr(10)), ''), '### Leia', '- Mais notícias' || array_to_string(list_transform(items, lambda x: chr(10) || " + _ITEM + "), '') || chr(10) || '- Fim', "
    "'1. um' || chr(10) || '2. dois', '> Fonte' || chr(10) || '> PF', '| Campo | Valor |' || chr(10) || '|---|---|' || chr(10) || '| página | ' || page_id || ' |' || chr(10) || '| endereço | [aqui](' || url || ') |')"
)
DRESSED_SQL = (
    "SELECT page_id, url, CASE WHEN error IS NULL THEN 'Notícias ' || page_id % 3 END AS section, CASE WHEN error IS NULL THEN 'Operação' END AS category, "
    "CASE WHEN error IS NULL THEN " + words_sql("title") + " END AS title, CASE WHEN error IS NULL THEN 'Linha fina & curta' END AS subtitle, "
    "CASE WHEN error IS NULL AND page_id % 7 <> 0 THEN '01/02/2024 09h15' END AS published_at, CASE WHEN error IS NULL AND page_id % 7 <> 0 AND page_id % 2 = 0 THEN '02/03/2024 10h00' END AS updated_at, "
    "CASE WHEN error IS NULL THEN 'Seção ' || page_id || '|Tema dois' END AS tags, CASE WHEN error IS NULL THEN " + _BODY + " END AS body, error FROM ("
    "SELECT page_id, url, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS paragraphs, "
    "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">[^<]*</a></li>') AS items, "
    "CASE WHEN page_id % 15 = 7 THEN 'no ''#content-core, .content-core'' in the page' WHEN page_id % 10 = 0 THEN 'no ''h1.documentFirstHeading'' in the page' END AS error FROM pages)"
)
DRESSED = {"dressed": (DRESSED_SQL, [])}


def index_table(spark, d):
    rows = v.news(spark, d)
    wanted = {"offset": F.col("doc_id").cast("int"), "item_index": F.lit(1), "titulo": F.col("titulo"), "tags": F.col("tags"), "subtitulo": F.col("subtitulo"), "link": F.col("link")}
    blank = spark.createDataFrame([], schemas.INDEX).schema
    return rows.select(*[(wanted[f.name] if f.name in wanted else F.lit(None)).cast(f.dataType).alias(f.name) for f in blank])


@query("src_index", sql("SELECT doc_id AS \"offset\", titulo, md5(subtitulo) AS subtitulo, tags, link FROM news", "news"))
def src_index(spark, d):
    path = scratch_dir(spark, "index")
    sinks.export_csv(index_table(spark, d), path)
    return tables.load_index(spark, path).select("offset", "titulo", F.md5("subtitulo").alias("subtitulo"), "tags", "link")


@query("src_manifest", sql("SELECT link, trim(markdown_path) AS markdown_path, status, erro FROM manifest", "manifest"))
def src_manifest(spark, d):
    path = scratch_dir(spark, "manifest")
    sinks.export_csv(v.manifest(spark, d).drop("seq"), path)
    return tables.load_manifest(spark, path).select("link", F.trim("markdown_path").alias("markdown_path"), "status", "erro")


@query(
    "src_bodies",
    sql("SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN concat('# ', markdown_text) ELSE markdown_text END) AS body, doc_id % 50 = 1 AS asked, count(*) OVER () AS paths FROM news", "news"),
)
def src_bodies(spark, d):
    """Bodies of two segments, the second of which replaces one in seven; some of them are looked up by path."""
    folder = scratch_dir(spark, "bodies")
    rows = v.news(spark, d).select("doc_id", F.concat(F.lit(v.FOLDER + "/"), "doc_id", F.lit(".md")).alias("markdown_path"), "markdown_text")
    body_store.append(rows, folder, 0, file_bytes=1 << 20)
    body_store.append(rows.where("doc_id % 7 = 0").withColumn("markdown_text", F.concat(F.lit("# "), "markdown_text")), folder, 1, file_bytes=1 << 20)
    asked = body_store.get(spark, folder, rows.where("doc_id % 50 = 1")).select("markdown_path", F.md5("markdown_text").alias("body"), F.lit(True).alias("asked"))
    found = tables.read_bodies(spark, folder).select("markdown_path", F.md5("markdown_text").alias("body"))
    number = F.regexp_extract("markdown_path", r"(\d+)\.md$", 1).cast("long")
    total = tables.list_bodies(spark, folder).agg(F.count(F.lit(1))).scalar()
    return found.join(asked, ["markdown_path", "body"], "left").select(number.alias("doc_id"), "body", F.coalesce("asked", F.lit(False)).alias("asked"), total.alias("paths"))


_DONE = "status = 'ok' AND markdown_path <> ''"


@query("src_body_exists", sql(f"SELECT link, markdown_path, seq FROM manifest WHERE {_DONE} AND markdown_path IN (SELECT markdown_path FROM bodies)", "manifest", "bodies"))
def body_exists(spark, d):
    return tables.usable_manifest(v.manifest(spark, d), v.bodies(spark, d)).select("link", "markdown_path", "seq")


@query("src_body_missing", sql(f"SELECT count(*) AS missing FROM manifest WHERE {_DONE} AND markdown_path NOT IN (SELECT markdown_path FROM bodies)", "manifest", "bodies"))
def body_missing(spark, d):
    return tables.missing_bodies(v.manifest(spark, d), v.bodies(spark, d))


LIST_SQL = (
    "SELECT CAST(page_id * 60 AS BIGINT) AS \"offset\", CAST(pos AS BIGINT) AS item_index, "
    + words_sql("regexp_extract(item, '>([^<]*)</a>', 1)")
    + " AS titulo, regexp_extract(item, 'href=\"([^\"]*)\"', 1) AS link FROM (SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS pos FROM "
    "(SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">[^<]*</a></li>') AS items FROM pages))"
)


def listing_pages(spark, d):
    return v.table(spark, d, "pages").select((F.col("page_id") * 60).alias("offset"), "html")


def dressed_listing(spark, d):
    """Listing pages in the default markup, an item for each link of the menu; one in three has no date in its byline."""
    stamp = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit(" publicado 01/02/2024  09h15"))
    item = (
        r'<article class="item tileItem"><span class="subtitle">Operação </span><h2 class="tileHeadline"><a href="$1">$2</a></h2><p class="tileBody"><span>Sobre <b>$2</b></span></p>'
        r'<span class="documentByLine">por X@@ Notícia</span><div class="keywords"><a>SP</a><a> </a><a>$2</a></div></article>'
    )
    items = F.regexp_replace(F.regexp_extract("html", "(?s)<nav><ul>(.*?)</ul></nav>", 1), r'<li><a href="([^"]*)">([^<]*)</a></li>', item)
    return v.table(spark, d, "pages").select((F.col("page_id") * 60).alias("offset"), F.replace(items, F.lit("@@"), stamp).alias("html"))


@query(
    "src_listing_extract",
    sql(
        "SELECT \"offset\", \"offset\" // 60 + 1 AS page_number, item_index, 'Operação' AS categoria, titulo, 'Sobre ' || titulo AS subtitulo, "
        "CASE WHEN dated THEN '01/02/2024' END AS data_publicacao, CASE WHEN dated THEN '09h15' END AS hora_publicacao, CASE WHEN dated THEN '01/02/2024 09h15' ELSE 'por X Notícia' END AS publicado_em, "
        "'Notícia' AS tipo_conteudo, 'SP | ' || titulo AS tags, CAST(2 AS BIGINT) AS total_tags, link, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, \"offset\" // 60 % 3 <> 0 AS dated FROM lst)",
        lst=(LIST_SQL, []),
    ),
)
def listing_extract(spark, d):
    return html.extract_listing(dressed_listing(spark, d))


@query(
    "src_lexicon",
    sql(
        "SELECT l.taxonomy, l.label, l.keyword, count(e.doc_id) AS docs FROM (VALUES "
        + ", ".join(f"('{t}', {v.q(l)}, {v.q(k)})" for t, r in (("crime", v.CRIMES), ("modus", v.MODUS)) for l, ks in r.items() for k in ks)
        + ") l(taxonomy, label, keyword) LEFT JOIN enr e ON contains(e.folded, l.keyword) GROUP BY ALL",
        "enr",
    ),
)
def lexicon(spark, d):
    hits = keyword_hits(v.enriched(spark, d)).groupBy("taxonomy", "label", "keyword").agg(F.count(F.lit(1)).alias("docs"))
    rules = lx.lexicon_table(spark, v.CRIMES, v.MODUS).drop("seq")
    return rules.join(hits, ["taxonomy", "label", "keyword"], "left").fillna(0, ["docs"])


@query("src_gazetteer", sql("SELECT g.uf, g.state, g.capital, g.lat, g.lon, count(n.doc_id) AS tagged FROM gaz g LEFT JOIN news n ON contains(concat('| ', n.tags, ' |'), concat('| ', g.uf, ' |')) GROUP BY ALL", "gaz", "news"))
def gazetteer(spark, d):
    tags = v.news(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("tags", r" \| "))).alias("uf"))
    counts = tags.where(F.col("uf").isin(geo.UFS)).groupBy("uf").agg(F.count(F.lit(1)).alias("tagged"))
    return geo.gazetteer(spark).join(counts, "uf", "left").fillna(0, ["tagged"])


@query("src_article_extract", sql("SELECT url, section, category, title, subtitle, published_at, updated_at, tags, body, error FROM dressed", **DRESSED))
def article_extract(spark, d):
    return html.extract_articles(dressed_pages(spark, d))


@query(
    "src_article_text",
    sql(
        "SELECT url, concat_ws(chr(10) || chr(10), section, category, '# ' || title, subtitle, 'Publicado em ' || published_at, 'Atualizado em ' || updated_at, 'Tags: ' || replace(tags, '|', ', '), body) AS markdown_text "
        "FROM dressed WHERE error IS NULL",
        **DRESSED,
    ),
)
def article_text(spark, d):
    return html.article_text(html.extract_articles(dressed_pages(spark, d))).select("url", "markdown_text")


@stage("artifact_folder", write=None)
def artifact_folder(spark, d):
    """All artifact tables of the corpus with vectors, published as one run; nothing is fitted."""
    rows = v.corpus(spark, d).drop("cluster_label").withColumn("markdown_path", F.concat(F.lit(v.FOLDER + "/"), "doc_id", F.lit(".md")))
    settings = analysis.Settings(threshold=v.THRESHOLD, strict=v.STRICT)
    terms = spark.createDataFrame([], "cluster_id INT, top_terms ARRAY<STRING>")
    path = scratch_dir(spark, "artifacts")
    run = artifacts.publish(analysis.analyse(rows, rows.select("link", "vec", "cluster_id"), terms, settings), path)
    stored = artifacts.read(spark, path)
    sinks.write_csvs({n: stored[n] for n in schemas.ARTIFACTS}, f"{run}/csv")
    return path


#: A whole number of each table whose sum is compared.
SUMMED = {
    "corpus_enriquecido": "ano", "vizinhos_semelhantes": "gap_days", "pares_recorrentes": "gap_days", "resumo_clusters": "size", "recorrencia_temporal": "noticias",
    "crimes_por_ano": "noticias", "modus_operandi_por_ano": "noticias", "series_semanticas": "size", "clusters_por_ano": "noticias", "estados_por_ano": "noticias",
    "estados_por_cluster": "noticias",
}
_COUNTED = "count(*) AS n FROM cor"
_ROWS = {
    "corpus_enriquecido": "SELECT ano AS n FROM cor", "vizinhos_semelhantes": "SELECT gap_days AS n FROM nb", "pares_recorrentes": "SELECT gap_days AS n FROM pairs",
    "resumo_clusters": f"SELECT {_COUNTED} GROUP BY cluster_id", "recorrencia_temporal": f"SELECT {_COUNTED} GROUP BY cluster_id",
    "crimes_por_ano": "SELECT count(*) AS n FROM (SELECT ano, unnest(crimes) AS l FROM cor WHERE ano IS NOT NULL) GROUP BY ano, l",
    "modus_operandi_por_ano": "SELECT count(*) AS n FROM (SELECT ano, unnest(modus) AS l FROM cor WHERE ano IS NOT NULL) GROUP BY ano, l",
    "series_semanticas": "SELECT size AS n FROM series", "clusters_por_ano": f"SELECT {_COUNTED} WHERE ano IS NOT NULL GROUP BY ano, cluster_id",
    "estados_por_ano": "SELECT count(*) AS n FROM (SELECT ano, unnest(ufs) AS l FROM cor WHERE ano IS NOT NULL) GROUP BY ano, l",
    "estados_por_cluster": "SELECT count(*) AS n FROM (SELECT cluster_id, unnest(ufs) AS l FROM cor) GROUP BY cluster_id, l",
}


@query(
    "snk_tables",
    sql(" UNION ALL ".join(f"SELECT '{t}' AS tabela, count(*) AS linhas, CAST(sum(n) AS BIGINT) AS soma FROM ({rows})" for t, rows in _ROWS.items()), "cor", "nb", "pairs", "series"),
)
def snk_tables(spark, d):
    """Rows of all tables, as another program finds them in the CSV exports of the newest run."""
    run, _ = artifacts.newest(spark, artifact_folder(spark, d))
    found = artifacts.read_csvs(spark, f"{run}/csv")
    each = [df.agg(F.lit(t).alias("tabela"), F.count(F.lit(1)).alias("linhas"), F.sum(SUMMED[t]).cast("long").alias("soma")) for t, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(
    "src_artifacts",
    sql(
        "SELECT c.link, CAST(year(pub_ts) AS BIGINT) AS year, coalesce(strftime(pub_ts, '%Y-%m'), 'NaT') AS month, array_to_string([trim(x) for x in string_split(tags, '|')], '|') AS tags_list, "
        "array_to_string(crimes, '|') AS crime_labels_list, array_to_string(ufs, '|') AS ufs_mencionadas_list, s.semantic_series_id IS NOT NULL AS has_series, s.semantic_series_id, t.size AS series_size, "
        "CAST(round(y.soma) AS BIGINT) AS vizinhos FROM cor c LEFT JOIN series_links s USING (link) LEFT JOIN series t USING (semantic_series_id) "
        "LEFT JOIN (SELECT source_link AS link, count(*) AS soma FROM nb GROUP BY 1) y USING (link)",
        "cor", "series_links", "series", "nb",
    ),
)
def src_artifacts(spark, d):
    """The reloaded tables of the newest run, joined on their keys."""
    found = artifacts.reload(artifacts.read(spark, artifact_folder(spark, d)))
    corpus = found["corpus_enriquecido"].select("link", "year", "month", "tags_list", "crime_labels_list", "ufs_mencionadas_list", "has_series", "semantic_series_id")
    series = found["series_semanticas"].select("semantic_series_id", F.col("size").alias("series_size"))
    near = found["vizinhos_semelhantes"].groupBy(F.col("source_link").alias("link")).agg(F.count(F.lit(1)).alias("vizinhos"))
    return corpus.join(series, "semantic_series_id", "left").join(near, "link", "left")
