"""Test views derived from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.functions import gazetteer as geo
from newsatlas.functions.lexicon import OPERATION_PHASE_WORDS, OPERATION_STOP_WORDS, STOP_WORDS
from newsatlas.functions.links import file_name
from newsatlas.operators import corpus as ops, graph, neighbours as near
from newsatlas.plans.catalog.registry import stage
from newsatlas.session import cut, spread_text

UF_LIST = "AC,AL,AP,AM,BA,CE,DF,ES,GO,MA,MT,MS,MG,PA,PB,PR,PE,PI,RJ,RN,RS,RO,RR,SC,SP,SE,TO"
NEWS = f"""
SELECT doc_id, doc_id AS seq,
       concat('https://example.org/noticias/', doc_id) AS link,
       CASE WHEN doc_id % 3 = 0 THEN concat('PF apreende carga em ', place)
            ELSE concat('PF deflagra Operação ', op, ' em ', place) END AS titulo,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE split_part(text, '.', 1) END AS subtitulo,
       concat(source, ' | ', uf1, CASE WHEN doc_id % 5 = 0 THEN concat(' | ', uf2) ELSE '' END) AS tags,
       CASE WHEN doc_id % 97 = 0 THEN NULL
            ELSE CAST(DATE '2012-01-01' + CAST((doc_id * 37) % 4800 AS INT) AS TIMESTAMP)
                 + CASE WHEN doc_id % 2 = 0 THEN INTERVAL '9' HOUR ELSE INTERVAL '17' HOUR END END AS pub_ts,
       concat(place, ' - ', text) AS markdown_text, lang, source, n_chars
FROM (SELECT *,
        split_part('Aurora,Bruma,Cais,Duna,Estrela Guia,Farol,Garoa', ',', CAST(doc_id % 7 AS INT) + 1) AS op,
        split_part('Rio Branco/AC,São Paulo/SP,Mato Grosso do Sul,Estado do Pará,Brasília/DF', ',', CAST(doc_id % 5 AS INT) + 1) AS place,
        split_part('{UF_LIST}', ',', CAST(doc_id % 27 AS INT) + 1) AS uf1,
        split_part('{UF_LIST}', ',', CAST((doc_id * 7) % 27 AS INT) + 1) AS uf2
      FROM <documents>) d
"""
CRIMES = {"t_tion": ["tion"], "t_ing": ["ing the"], "t_schung": ["schung"], "t_eaux": ["eaux"]}
MODUS = {"t_license": ["license", "zzz never zzz"], "t_at": ["@"], "t_ing": ["ing the"]}
THRESHOLD, STRICT = 0.28, 0.32
FOLDER = "corpus/bodies"


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wide = {"documents": "text", "pages": "html"}
    return spread_text(rows, wide[name], *keys) if name in wide else rows


def news(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return spark.sql(NEWS.replace("<documents>", "{documents}"), documents=table(spark, sf_dir, "documents", *keys))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled news, not stored: a step that reads a few of their columns computes no others."""
    return ops.enrich(ops.with_dates(news(spark, sf_dir), "pub_ts"), CRIMES, MODUS)


@stage("news")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage table that summaries and filters read."""
    return labelled(spark, sf_dir)


@stage("corpus")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched news with a vector and a cluster each.

    News meet their vectors before they are labelled, so that no text is read for labels that nobody asks for. The
    steps towards the search text, and the texts of the semantic space, which is made of all news, are not kept.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").alias("cluster_id")
    )
    rows = ops.with_dates(news(spark, sf_dir, "doc_id").join(vectors, "doc_id"), "pub_ts")
    rows = ops.enrich(rows, CRIMES, MODUS).drop("texto_limpo", "texto_busca", "texto_sem_geo", "texto_ponderado")
    return rows.withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")))


@stage("neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return near.neighbour_table(rows, near.nearest(rows.select("link", "vec"), "link", 5))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.recurring_pairs(neighbours(spark, sf_dir), THRESHOLD, STRICT)


@stage("components")
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(pairs(spark, sf_dir))


@stage("component_series", write=None)
def described_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assignments and series of the components, described once for both."""
    assigned, summary = graph.component_series(corpus(spark, sf_dir), parts(spark, sf_dir))
    return assigned, cut(summary)


def first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described_parts(spark, sf_dir)[0]


def first_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described_parts(spark, sf_dir)[1]


@stage("consolidated", write=None)
def consolidated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links and series after consolidation, described once for both; the links are written only where they are asked for."""
    links, merged = graph.consolidate(corpus(spark, sf_dir), first_links(spark, sf_dir), first_series(spark, sf_dir))
    return links, cut(merged)


@stage("series_links")
def series_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir)[0]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir)[1]


def corpus_with_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.assign_series(corpus(spark, sf_dir), series_links(spark, sf_dir))


IDX = """
SELECT concat(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE '' END, link) AS link, seq, titulo FROM {news} n
UNION ALL SELECT link, seq + 1000000 AS seq, titulo FROM {news} n WHERE doc_id % 13 = 0
UNION ALL SELECT '   ' AS link, seq + 2000000 AS seq, titulo FROM {news} n WHERE doc_id % 17 = 0
"""
MANIFEST = """
SELECT concat('https://example.org/noticias/', doc_id) AS link,
       CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE concat('corpus/bodies/', doc_id, '.md') END AS markdown_path,
       CASE WHEN quality = 1 THEN 'ok' ELSE 'erro' END AS status,
       CASE WHEN quality = 1 THEN NULL ELSE 'sem titulo' END AS erro, doc_id AS seq FROM {labels} l
UNION ALL
SELECT concat('https://example.org/noticias/', doc_id) AS link, concat('corpus/bodies/', doc_id, '.md') AS markdown_path,
       'ok' AS status, NULL AS erro, doc_id + 1000000 AS seq FROM {labels} l WHERE doc_id % 10 = 0
"""


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IDX, news=news(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST, labels=table(spark, sf_dir, "labels"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that hold a body: recorded and generated names, except for doc_id % 19 = 0."""
    ids = table(spark, sf_dir, "labels").where("doc_id % 19 <> 0").select(
        F.concat(F.lit("https://example.org/noticias/"), F.col("doc_id")).alias("link"), "doc_id"
    )
    named = F.when(F.col("doc_id") % 7 == 0, file_name("link")).otherwise(F.concat(F.col("doc_id"), F.lit(".md")))
    both = F.array(named, F.concat(F.col("doc_id"), F.lit(".md")))
    return ids.select(F.explode(both).alias("name")).select(F.concat(F.lit(FOLDER + "/"), F.col("name")).alias("markdown_path"))


# SQL side --------------------------------------------------------------------------------------

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return rf"lower(regexp_replace(strip_accents({x}), '[^\x00-\x7f]', '', 'g'))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def clean_md(x: str) -> str:
    x = rf"regexp_replace({x}, '(?s)`{{1,3}}.*?`{{1,3}}', ' ', 'g')"
    x = rf"regexp_replace({x}, '\[(.*?)\]\((.*?)\)', '\1', 'g')"
    return collapse(rf"regexp_replace({x}, '[*_>#-]+', ' ', 'g')")


def label(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'sem_rotulo')"


def without_geo(x: str) -> str:
    places, codes = "|".join(geo.PHRASES), "|".join(u.lower() for u in geo.UFS)
    x = rf"regexp_replace(strip_accents({x}), '\b[\p{{L}}\p{{N}}_'' -]{{2,60}}/[A-Z]{{2}}\b', ' ', 'g')"
    x = rf"lower(regexp_replace({x}, '[^\x00-\x7f]', '', 'g'))"
    return collapse(rf"regexp_replace({x}, '\b(?:{places})\b|\b(?:{codes})\b|\d+', ' ', 'g')")


def words_sql(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def labels_sql(text: str, rules: dict) -> str:
    cases = [
        f"CASE WHEN {' OR '.join(f'contains({text}, {q(k)})' for k in keys)} THEN {q(name)} END" for name, keys in rules.items()
    ]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def ufs_sql(tag_keys: str, headline: str, codes: str) -> str:
    cases = []
    for uf in geo.UFS:
        name = geo.STATE_OF[uf].lower()
        head = {
            "SP": rf"regexp_matches(regexp_replace({headline}, 'sao paulo\s+de\b', '', 'g'), '\bsao paulo\b')",
            "PA": rf"regexp_matches({headline}, '\bestado do para\b')",
        }.get(uf, rf"regexp_matches({headline}, '\b{name}\b')")
        cases.append(
            f"CASE WHEN list_contains({tag_keys}, {q(name)}) OR list_contains({tag_keys}, {q(uf.lower())}) "
            f"OR {head} OR list_contains({codes}, {q(uf)}) THEN {q(uf)} END"
        )
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_GAZ = ", ".join(f"({q(u)}, {q(s)}, {q(c)}, CAST({la!r} AS DOUBLE), CAST({lo!r} AS DOUBLE))" for u, s, c, la, lo in geo.STATES)
_STOPS = words_sql(OPERATION_STOP_WORDS + OPERATION_PHASE_WORDS)
_STATE_MAP = "MAP {" + ", ".join(f"{q(u)}: {q(s)}" for u, s in geo.STATE_OF.items()) + "}"

CTES: dict[str, tuple[str, list[str]]] = {
    "news": (NEWS.replace("<documents>", "documents"), []),
    "gaz": (f"SELECT * FROM (VALUES {_GAZ}) t(uf, state, capital, lat, lon)", []),
    "txt": (
        f"SELECT *, {fold('texto_busca')} AS folded FROM (SELECT *, "
        f"{strip('''concat(coalesce(titulo,''), ' ', coalesce(subtitulo,''), ' ', replace(coalesce(tags,''), '|', ' '), ' ', clean)''')} AS texto_busca "
        f"FROM (SELECT *, {clean_md('markdown_text')} AS clean FROM news))",
        ["news"],
    ),
    "ops": (
        "SELECT *, CASE WHEN len(w) > 0 AND w[1] NOT IN " + words_sql(OPERATION_STOP_WORDS) + " THEN array_to_string("
        "[upper(x[1]) || x[2:] for x in w[1:least(3, coalesce(list_min([i for i in range(2, len(w) + 1) if w[i] IN " + _STOPS + "]) - 1, len(w)))]], ' ') END AS nome_operacao "
        rf"FROM (SELECT *, [x for x in string_split_regex(regexp_extract({fold('titulo')}, 'operacao\s+([a-z0-9\s-]{{2,60}})', 1), '\s+') if x <> ''] AS w FROM txt)",
        ["txt"],
    ),
    "enr": (
        f"SELECT * EXCLUDE (w), pub_ts AS data_publicacao_dt, CAST(year(pub_ts) AS BIGINT) AS ano, CAST(month(pub_ts) AS BIGINT) AS mes, "
        f"coalesce(strftime(pub_ts, '%Y-%m'), 'NaT') AS ano_mes, {labels_sql('folded', CRIMES)} AS crimes, {labels_sql('folded', MODUS)} AS modus, "
        + ufs_sql("tag_keys", "headline", "codes")
        + f" AS ufs FROM (SELECT *, {fold('''concat(coalesce(titulo,''), ' ', coalesce(subtitulo,''))''')} AS headline, "
        f"[{fold('trim(t)')} for t in string_split(tags, '|')] AS tag_keys, "
        r"regexp_extract_all(left(markdown_text, 1200), '\b[\p{L}\p{N}_'' -]{2,60}/([A-Z]{2})\b', 1) AS codes FROM ops)",
        ["ops"],
    ),
    "cor": (
        "SELECT e.*, v.embedding AS vec, CAST(v.label AS BIGINT) AS cluster_id, concat('cluster_', v.label) AS cluster_label "
        "FROM enr e JOIN embeddings v ON e.doc_id = v.vec_id",
        ["enr"],
    ),
    "weighted": (
        f"SELECT *, {strip('''concat(repeat(coalesce(titulo,'') || ' ', 3), repeat(coalesce(subtitulo,'') || ' ', 2), sem_geo)''')} AS ponderado "
        f"FROM (SELECT *, {without_geo('texto_busca')} AS sem_geo FROM txt)",
        ["txt"],
    ),
    "tok": (
        "SELECT doc_id, link, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS terms FROM ("
        rf"SELECT doc_id, link, [t for t in regexp_extract_all({without_geo('ponderado')}, '\b[a-z0-9-]{{2,}}\b') if t NOT IN {words_sql(STOP_WORDS)}] AS w FROM weighted)",
        ["weighted"],
    ),
    "unitv": (
        "SELECT link, v, sqrt(list_dot_product(v, v)) AS len FROM (SELECT link, CAST(vec AS DOUBLE[]) AS v FROM cor)",
        ["cor"],
    ),
    "knn": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, t) AS rnk FROM ("
        "SELECT a.link AS s, b.link AS t, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) AS sim "
        "FROM unitv a JOIN unitv b ON a.link <> b.link)) WHERE rnk <= 5",
        ["unitv"],
    ),
    "nb": (
        "SELECT s AS source_link, a.titulo AS source_titulo, a.data_publicacao_dt AS source_data, t AS target_link, b.titulo AS target_titulo, "
        "b.data_publicacao_dt AS target_data, rnk AS rank, sim AS cosine_similarity, a.cluster_id AS source_cluster_id, b.cluster_id AS target_cluster_id, "
        "a.nome_operacao AS source_operation_name, b.nome_operacao AS target_operation_name, a.cluster_id = b.cluster_id AS same_cluster, "
        "CAST(abs(floor((epoch(b.data_publicacao_dt) - epoch(a.data_publicacao_dt)) / 86400)) AS BIGINT) AS gap_days "
        "FROM knn JOIN cor a ON a.link = s JOIN cor b ON b.link = t",
        ["knn", "cor"],
    ),
    "pairs": (
        "SELECT * EXCLUDE (pk) FROM (SELECT *, row_number() OVER (PARTITION BY least(source_link, target_link), greatest(source_link, target_link) "
        "ORDER BY cosine_similarity DESC, gap_days DESC, source_link) AS pk FROM nb WHERE coalesce(gap_days, 0) >= 30 AND same_cluster AND "
        f"(cosine_similarity >= {STRICT} OR (coalesce(source_operation_name, '') <> '' AND source_operation_name = target_operation_name "
        f"AND cosine_similarity >= {THRESHOLD}))) WHERE pk = 1",
        ["nb"],
    ),
    "edges": ("SELECT source_link AS a, target_link AS b FROM pairs UNION SELECT target_link, source_link FROM pairs", ["pairs"]),
    "reach": ("SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a", ["edges"]),
    "parts": ("SELECT node, min(other) AS component FROM reach GROUP BY node", ["reach"]),
}


def tops(name: str, src: str, grp: str, value: str, k: int, sep: str = " | ") -> dict[str, tuple[str, list[str]]]:
    """CTE ``name`` (grp, packed): the k most frequent values per group, as a list."""
    return {
        name: (
            f"SELECT {grp}, list(v ORDER BY rn) AS vals FROM (SELECT {grp}, v, row_number() OVER (PARTITION BY {grp} ORDER BY n DESC, v) AS rn "
            f"FROM (SELECT {grp}, v, count(*) AS n FROM (SELECT {grp}, {value} AS v FROM {src}) WHERE v IS NOT NULL GROUP BY ALL)) WHERE rn <= {k} GROUP BY {grp}",
            [src],
        )
    }


def titles(name: str, src: str, grp: str) -> dict[str, tuple[str, list[str]]]:
    return {
        name: (
            f"SELECT {grp}, list(titulo ORDER BY rn) AS vals FROM (SELECT {grp}, titulo, row_number() OVER (PARTITION BY {grp} "
            f"ORDER BY data_publicacao_dt ASC NULLS LAST, link) AS rn FROM {src}) WHERE rn <= 3 GROUP BY {grp}",
            [src],
        )
    }


def _series(prefix: str, src: str, grp: str, size: str) -> dict[str, tuple[str, list[str]]]:
    """CTEs that describe groups of articles as series; the last one is ``<prefix>_desc``."""
    p = prefix
    out = {}
    out |= tops(f"{p}_ops", src, grp, "nullif(nome_operacao, '')", 5)
    out |= tops(f"{p}_cri", src, grp, "unnest(crimes)", 5)
    out |= titles(f"{p}_tit", src, grp)
    out[f"{p}_mod"] = (
        f"SELECT {grp}, list_sort(list(cluster_id))[1:3] AS vals FROM (SELECT {grp}, cluster_id, rank() OVER (PARTITION BY {grp} ORDER BY count(*) DESC) AS rk "
        f"FROM {src} GROUP BY {grp}, cluster_id) WHERE rk = 1 GROUP BY {grp}",
        [src],
    )
    out[f"{p}_desc"] = (
        f"SELECT *, CASE WHEN len(o) > 0 THEN array_to_string(o[1:3], ' | ') WHEN len(c) > 0 THEN 'serie_por_crime_' || array_to_string(c[1:2], ' | ') "
        f"WHEN len(t) > 0 THEN left(t[1], 90) WHEN len(m) > 0 THEN concat('serie_cluster_', m[1]) ELSE 'serie_sem_nome' END AS series_label FROM ("
        f"SELECT g.*, coalesce(o.vals, []) AS o, coalesce(c.vals, []) AS c, coalesce(t.vals, []) AS t, coalesce(m.vals, []) AS m FROM ("
        f"SELECT {grp}, {size} AS size, min(data_publicacao_dt) AS first_date, max(data_publicacao_dt) AS last_date, count(DISTINCT ano) AS active_years FROM {src} GROUP BY {grp}) g "
        f"LEFT JOIN {p}_ops o USING ({grp}) LEFT JOIN {p}_cri c USING ({grp}) LEFT JOIN {p}_tit t USING ({grp}) LEFT JOIN {p}_mod m USING ({grp}))",
        [f"{p}_ops", f"{p}_cri", f"{p}_tit", f"{p}_mod"],
    )
    return out


KEY_SQL = (
    f"CASE WHEN len(o) > 0 THEN 'operation::' || {label('''array_to_string(o, ' | ')''')} "
    f"WHEN len(c) > 0 THEN 'crime::' || {label('''array_to_string(c, ' | ')''')} ELSE 'label::' || {label('series_label')} END"
)
SERIES_COLUMNS = (
    "semantic_series_id, size, strftime(first_date, '%Y-%m-%d %H:%M:%S') AS first_date, strftime(last_date, '%Y-%m-%d %H:%M:%S') AS last_date, "
    "span_days, active_years, cluster_modes, operation_names, series_group_key, series_label, series_display_label, crime_modes, sample_titles"
)


def _series_rows(src: str) -> str:
    return (
        "SELECT semantic_series_id, size, first_date, last_date, CAST(floor((epoch(last_date) - epoch(first_date)) / 86400) AS BIGINT) AS span_days, active_years, "
        "array_to_string(m, ' | ') AS cluster_modes, array_to_string(o, ' | ') AS operation_names, series_group_key, series_label, "
        "concat(series_label, ' | ', coalesce(year(first_date), 0), '-', coalesce(year(last_date), 0), ' | c', coalesce(CAST(m[1] AS VARCHAR), '?'), ' | n=', size, ' | id=', semantic_series_id) AS series_display_label, "
        f"array_to_string(c, ' | ') AS crime_modes, array_to_string(t, ' || ') AS sample_titles FROM {src}"
    )


CTES["part_rows"] = ("SELECT p.component, c.* FROM parts p JOIN cor c ON c.link = p.node", ["parts", "cor"])
CTES |= _series("a", "part_rows", "component", "count(*)")
CTES["a_num"] = (f"SELECT *, {KEY_SQL} AS series_group_key, row_number() OVER (ORDER BY size DESC, component) AS semantic_series_id FROM a_desc", ["a_desc"])
CTES["first_series"] = (_series_rows("a_num"), ["a_num"])
CTES["key_rows"] = ("SELECT a.series_group_key, a.series_label AS part_label, a.semantic_series_id AS part_id, r.* FROM part_rows r JOIN a_num a USING (component)", ["part_rows", "a_num"])
CTES |= _series("b", "key_rows", "series_group_key", "count(DISTINCT link)")
CTES["b_num"] = ("SELECT *, row_number() OVER (ORDER BY size DESC, first_date ASC NULLS LAST, series_label, series_group_key) AS semantic_series_id FROM b_desc", ["b_desc"])
CTES["series"] = (_series_rows("b_num"), ["b_num"])
CTES["series_links"] = ("SELECT DISTINCT k.link, b.semantic_series_id FROM key_rows k JOIN b_num b USING (series_group_key)", ["key_rows", "b_num"])
CTES["ui"] = (
    "SELECT *, concat(CASE WHEN starts_with(series_group_key, 'crime::') AND trim(crime_modes) <> '' THEN 'serie_por_crime_' || trim(crime_modes) ELSE series_label END, "
    "' | ', coalesce(year(first_date), 0), '-', coalesce(year(last_date), 0), ' | c', coalesce(nullif(string_split(cluster_modes, ' | ')[1], ''), '?'), ' | n=', size, ' | id=', semantic_series_id) AS series_ui_label, "
    "CASE WHEN trim(operation_names) <> '' THEN 'Com operação nomeada' WHEN starts_with(series_group_key, 'crime::') THEN 'Por crime' ELSE 'Outras' END AS series_type, "
    "size * active_years AS strength_score, CASE WHEN size >= 20 OR size * active_years >= 60 OR (size >= 10 AND active_years >= 4) THEN 'Forte' "
    "WHEN size >= 5 OR active_years >= 3 OR size * active_years >= 15 THEN 'Média' ELSE 'Fraca' END AS strength_band, "
    "CAST(year(first_date) AS BIGINT) AS start_year, CAST(year(last_date) AS BIGINT) AS end_year FROM series",
    ["series"],
)
CTES["idx"] = (IDX.replace("{news}", "news"), ["news"])
CTES["manifest"] = (MANIFEST.replace("{labels}", "labels"), [])


def slug_name(link: str) -> str:
    path = rf"regexp_extract({link}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    last = rf"string_split(regexp_replace({path}, '/+$', ''), '/')[-1]"
    name = rf"lower(trim(regexp_replace({last}, '[^a-zA-Z0-9_-]+', '-', 'g'), '-'))"
    return rf"coalesce(nullif({name}, ''), 'noticia-' || left(md5({link}), 10))"


def file_name_sql(link: str) -> str:
    return f"{slug_name(link)} || '-' || left(md5({link}), 8) || '.md'"


CTES["bodies"] = (
    f"SELECT '{FOLDER}/' || CASE WHEN doc_id % 7 = 0 THEN {file_name_sql('link')} ELSE concat(doc_id, '.md') END AS markdown_path FROM "
    "(SELECT doc_id, concat('https://example.org/noticias/', doc_id) AS link FROM labels WHERE doc_id % 19 <> 0) "
    f"UNION SELECT concat('{FOLDER}/', doc_id, '.md') FROM labels WHERE doc_id % 19 <> 0",
    [],
)


def sql(body: str, *needs: str, **extra: tuple[str, list[str]]) -> str:
    """A query over the named CTEs, with what they depend on; ``extra`` adds CTEs of its own."""
    pool = {**CTES, **extra}
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in pool.get(name, ("", []))[1]:
            if dep != name:
                visit(dep)
        if name in pool and name not in order:
            order.append(name)

    for name in (*needs, *extra):
        visit(name)
    heads = ", ".join(f"{n} AS ({pool[n][0]})" for n in order)
    return (f"WITH RECURSIVE {heads} " if order else "") + body
