"""Registered queries against their SQL twins, and one whole run over files."""

import os
import random

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from newsatlas.plans import analysis
from newsatlas.sources import artifacts, schemas

SF = "/root/testdata/sf0.001"
# A cross-section; NEWSATLAS_ALL=1 compares every key.
SOME = [
    "agg_labels_by_year", "agg_crime_state_year", "agg_temporal", "agg_cluster_summary", "flt_regex", "fn_slug", "ing_extract",
    "jn_corpus", "prj_weighted_text", "qry_fuzzy_text", "qry_signal_trend", "sem_cluster_network", "sem_consolidate", "sem_knn",
    "sem_threshold_knn", "sem_tfidf", "set_dedup_pair", "src_article_extract", "topk_examples", "win_gap",
    "set_row_labels", "agg_catalog_crimes", "agg_catalog_modus", "qry_dual_compare_uf", "fn_list_cell", "src_listing_extract", "rep_report",
    "src_article_text", "src_bodies", "src_artifacts", "sem_network_layout", "qry_dual_compare_text", "fn_keyword_labels_wide",
]
KEYS = sorted(entry.queries()) if os.environ.get("NEWSATLAS_ALL") else SOME
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@needs_data
@pytest.mark.parametrize("name", KEYS)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, connect(SF), sql) is None


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["ano", "crime_label", "noticias"]
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


TOPICS = {
    "Aurora": "apreensão de cocaína e maconha na fronteira com mandado de busca",
    "Bruma": "lavagem de dinheiro e bloqueio de bens de empresários investigados",
    "Cais": "garimpo ilegal e desmatamento em terras protegidas pelo ibama",
}


def test_whole_run(spark, tmp_path):
    rng = random.Random(4)
    bodies, index, manifest = tmp_path / "bodies", ["link,titulo,subtitulo,tags,publicado_em"], ["link,markdown_path,status,publicado_em_extraido"]
    bodies.mkdir()
    names = list(TOPICS)
    for i in range(60):
        op = names[i % 3]
        words = TOPICS[op].split()
        rng.shuffle(words)
        (bodies / f"{i}.md").write_text(f"Natal/RN - {TOPICS[op]} {' '.join(words)}", encoding="utf-8")
        index.append(f"l{i},PF deflagra Operação {op} em Natal,,Bahia | {op},")
        manifest.append(f"l{i},{bodies / f'{i}.md'},{'ok' if i < 57 else 'erro'},{1 + i % 28:02d}/{1 + i % 12:02d}/{2015 + i % 5} 09h15")
    manifest[1] = manifest[1].replace("0.md", "lost.md")
    (tmp_path / "index.csv").write_text("\n".join(index), encoding="utf-8")
    (tmp_path / "manifest.csv").write_text("\n".join(manifest), encoding="utf-8")
    settings = analysis.Settings(candidates=(3,), final_starts=2, components=6)
    out = str(tmp_path / "out")
    analysis.run(spark, str(tmp_path / "index.csv"), str(tmp_path / "manifest.csv"), str(bodies), out, settings)
    stored = artifacts.read(spark, out)
    out = artifacts.newest(spark, out)[0]
    read = stored.__getitem__
    corpus = read("corpus_enriquecido")
    assert corpus.count() == 56 and corpus.columns == analysis.CORPUS_COLUMNS
    assert read("vizinhos_semelhantes").count() == 56 * 5
    assert sum(r["size"] for r in read("resumo_clusters").collect()) == 56
    assert {r["crime_label"] for r in read("crimes_por_ano").collect()} >= {"trafico_drogas", "lavagem_dinheiro", "crimes_ambientais"}
    assert {r["uf"] for r in read("estados_por_ano").collect()} == {"BA", "RN"}
    series = read("series_semanticas").orderBy("semantic_series_id").collect()
    assert [r["semantic_series_id"] for r in series] == list(range(1, len(series) + 1)) and len(series) >= 1
    assert {r["operation_names"] for r in series} <= set(names)
    pairs = read("pares_recorrentes").collect()
    assert pairs and all(r["gap_days"] >= 30 and r["same_cluster"] and r["cosine_similarity"] >= 0.7 for r in pairs)
    files = [f for f in os.listdir(f"{out}/csv/crimes_por_ano") if f.startswith("part-")]
    assert len(os.listdir(f"{out}/csv")) == 11 and files
    assert all(open(f"{out}/csv/crimes_por_ano/{f}", "rb").read(3) == b"\xef\xbb\xbf" for f in files)
    lines = [r["value"] for r in spark.read.text(f"{out}/analise_qualitativa_md").collect()]
    assert lines[0].startswith("# ") and "- Base analisada: 56 noticias" in lines
    derived = artifacts.reload(artifacts.read_csvs(spark, f"{out}/csv"))
    assert all(derived[n].count() == stored[n].count() for n in schemas.ARTIFACTS)
    own, again = (x["corpus_enriquecido"].orderBy("link").select("link", "ano", "data_publicacao_dt", "crime_labels_list", "ufs_mencionadas_list", "has_series", "month").collect() for x in (artifacts.reload(stored), derived))
    assert own == again and any(r["has_series"] for r in own)
    assert {r["series_ui_label"] for r in derived["series_semanticas"].collect()} == {r["series_ui_label"] for r in artifacts.reload(stored)["series_semanticas"].collect()}


def test_only_news_with_a_vector_are_labelled_for_the_corpus(spark, tmp_path, monkeypatch):
    from newsatlas.plans.catalog import views

    texts = ["Feira de Santana/BA - apreensão  de\tcarga, tion", "São Paulo/SP e Natal/RN - schung ½ … fim", "", None, "ing the \u00a0 #x`y` [a](b)"]
    docs = [(i, texts[i % 5], "pt", "web", 9) for i in range(40)] + [(7, "again", "pt", "web", 5), (None, "x", "pt", "web", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(i)], i % 2) for i in (5, 6, 7, 8, 99)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = views.enriched(spark, str(tmp_path)).where("doc_id IN (5, 6, 7, 8)")
    seen, enrich = [], views.ops.enrich
    monkeypatch.setattr(views.ops, "enrich", lambda df, *rules: seen.append(df.count()) or enrich(df, *rules))
    rows = views.corpus(spark, str(tmp_path))
    assert seen == [5]
    shared = [c for c in wanted.columns if c in rows.columns]
    assert "texto_busca_normalizado" in shared and "texto_ponderado" not in shared
    read = lambda df: sorted(map(repr, df.select(*shared).collect()))
    assert read(rows) == read(wanted) and len(read(rows)) == 5


def artifact_tables(spark, mark):
    return {n: spark.createDataFrame([], ddl) for n, ddl in {**schemas.ARTIFACTS, schemas.REPORT[0]: schemas.REPORT[1]}.items()} | {
        "crimes_por_ano": spark.createDataFrame([(mark, "x", 1)], schemas.ARTIFACTS["crimes_por_ano"])
    }


def test_a_failed_run_leaves_the_run_before(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        artifacts.read(spark, folder)
    artifacts.publish(artifact_tables(spark, 2001), folder)
    broken = artifact_tables(spark, 2002)
    broken["estados_por_cluster"] = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        artifacts.publish(broken, folder)
    assert len(os.listdir(f"{folder}/runs")) == 2  # half of the second run is there
    assert artifacts.read(spark, folder)["crimes_por_ano"].first()["ano"] == 2001
    artifacts.publish(artifact_tables(spark, 2003), folder)
    assert artifacts.read(spark, folder)["crimes_por_ano"].first()["ano"] == 2003
    assert [r["number"] for r in artifacts.log(spark, folder).orderBy("number").collect()] == [1, 2]


def test_artifacts_of_another_shape_are_refused(spark, tmp_path):
    folder = str(tmp_path / "a")
    other = artifact_tables(spark, 1) | {"crimes_por_ano": spark.createDataFrame([("1", "x")], "ano STRING, crime STRING")}
    artifacts.publish(other, folder)
    with pytest.raises(ValueError, match="crimes_por_ano.*ano: string instead of int.*crime: string instead of none"):
        artifacts.read(spark, folder)
    artifacts.publish({k: v for k, v in other.items() if k != "estados_por_ano"}, folder)
    with pytest.raises(ValueError, match="missing.*estados_por_ano"):
        artifacts.read(spark, folder)
