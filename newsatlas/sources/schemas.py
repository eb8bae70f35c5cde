"""Schemas of the tables that enter and leave the engine. The names are the data contract."""

from __future__ import annotations

INDEX = (
    "offset INT, page_number INT, item_index INT, categoria STRING, titulo STRING, subtitulo STRING, "
    "data_publicacao STRING, hora_publicacao STRING, publicado_em STRING, tipo_conteudo STRING, tags STRING, "
    "total_tags INT, link STRING"
)
MANIFEST = (
    "link STRING, markdown_path STRING, status STRING, titulo_extraido STRING, subtitulo_extraido STRING, "
    "publicado_em_extraido STRING, atualizado_em_extraido STRING, tags_extraidas STRING, erro STRING"
)
PAGES = "page_id BIGINT, url STRING, html STRING"
CORPUS_COLUMNS = [
    "link", "titulo", "subtitulo", "data_publicacao_dt", "ano", "mes", "ano_mes", "tags", "nome_operacao",
    "cluster_id", "cluster_label", "semantic_series_id", "crime_labels", "modus_labels", "ufs_mencionadas",
    "estados_mencionados", "texto_busca_normalizado", "markdown_path",
]
OK, FAILED = "ok", "erro"

_PAIR = (
    "source_link STRING, source_titulo STRING, source_data TIMESTAMP, target_link STRING, target_titulo STRING, target_data TIMESTAMP, rank INT, "
    "cosine_similarity DOUBLE, source_cluster_id INT, target_cluster_id INT, source_operation_name STRING, target_operation_name STRING, same_cluster BOOLEAN, gap_days INT"
)
#: The tables of an artifact folder.
ARTIFACTS = {
    "corpus_enriquecido": (
        "link STRING, titulo STRING, subtitulo STRING, data_publicacao_dt TIMESTAMP, ano INT, mes INT, ano_mes STRING, tags STRING, nome_operacao STRING, cluster_id INT, "
        "cluster_label STRING, semantic_series_id BIGINT, crime_labels ARRAY<STRING>, modus_labels ARRAY<STRING>, ufs_mencionadas ARRAY<STRING>, "
        "estados_mencionados ARRAY<STRING>, texto_busca_normalizado STRING, markdown_path STRING"
    ),
    "vizinhos_semelhantes": _PAIR,
    "pares_recorrentes": _PAIR,
    "resumo_clusters": (
        "cluster_id INT, size BIGINT, first_date TIMESTAMP, last_date TIMESTAMP, active_years INT, top_terms STRING, top_tags STRING, top_states STRING, "
        "top_crimes STRING, top_modus STRING, sample_titles STRING, cluster_label STRING"
    ),
    "recorrencia_temporal": (
        "cluster_id INT, noticias BIGINT, active_years INT, active_months INT, peak_year_month STRING, peak_year_month_count BIGINT, peak_calendar_month INT, "
        "peak_calendar_month_count BIGINT, peak_calendar_month_share DOUBLE, median_gap_days DOUBLE, mean_gap_days DOUBLE, repeats_across_years BOOLEAN"
    ),
    "crimes_por_ano": "ano INT, crime_label STRING, noticias BIGINT",
    "modus_operandi_por_ano": "ano INT, modus_label STRING, noticias BIGINT",
    "series_semanticas": (
        "semantic_series_id BIGINT, size INT, first_date TIMESTAMP, last_date TIMESTAMP, span_days INT, active_years INT, cluster_modes STRING, operation_names STRING, "
        "series_group_key STRING, series_label STRING, series_display_label STRING, crime_modes STRING, sample_titles STRING"
    ),
    "clusters_por_ano": "ano INT, cluster_id INT, cluster_label STRING, noticias BIGINT",
    "estados_por_ano": "ano INT, uf STRING, state STRING, lat DOUBLE, lon DOUBLE, noticias BIGINT",
    "estados_por_cluster": "cluster_id INT, uf STRING, state STRING, lat DOUBLE, lon DOUBLE, noticias BIGINT",
}
REPORT = ("analise_qualitativa", "section INT, rank INT, line STRING")
