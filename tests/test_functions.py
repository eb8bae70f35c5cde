"""Exact semantics of the column functions on hand-written rows."""

import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from newsatlas.functions import dates, gazetteer as geo, labels, lexicon, links, series, text
from newsatlas.operators import corpus as ops


def test_white_space(one):
    assert one(text.clean_text("t"), t="  a \n\t b  ") == "a b"
    assert one(text.clean_text("t"), t="   ") is None
    assert one(text.clean_text("t"), t=None) is None
    assert one(text.strip("t"), t="\n x y 　") == "x y"


def test_fold_on_every_expanding_character(spark):
    rows = [(chr(c) + "z",) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    for r in spark.createDataFrame(rows, "t string").select("t", text.fold("t").alias("f"), text.fold(text.fold("t")).alias("ff")).collect():
        expected = unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode().lower()
        assert r["f"] == expected == r["ff"], hex(ord(r["t"][0]))


def test_fold_sentences(one):
    assert one(text.fold("t"), t="Operação “São João” – ½ …ﬁm") == "operacao sao joao  12 ...fim"


def test_strip_markdown(one):
    md = "# Título\n\n```\ncode\n``` [link](http://x) *negrito* -- fim\n"
    assert one(text.strip_markdown("t"), t=md) == "Título link negrito fim"


def test_labels_and_excerpts(one):
    assert one(text.normalize_label("t"), t="Ação -- Já!") == "a_o_j"
    assert one(text.normalize_label("t"), t="--") == "sem_rotulo"
    assert one(text.pretty_label("t"), t="lavagem_dinheiro") == "Lavagem Dinheiro"
    assert one(text.excerpt("t", 3), t="abcd") == "abc..."
    assert one(text.excerpt("t", 4), t="abcd") == "abcd"
    assert one(text.excerpt("t"), t=None) == "Conteúdo markdown não encontrado."
    assert one(text.html_escape("t"), t="<a & 'b'>\"") == "&lt;a &amp; &#x27;b&#x27;&gt;&quot;"


def test_list_cells(one):
    assert one(text.unpack_list("t"), t="['a', 'b c']") == ["a", "b c"]
    assert one(text.unpack_list("t"), t=" x | | y ") == ["x", "y"]
    assert one(text.unpack_list("t"), t="[]") == []
    assert one(text.unpack_list("t"), t="  ") == [] == one(text.unpack_list("t"), t=None)


def test_pattern_that_is_not_valid_is_literal(one):
    assert one(text.contains_pattern("t", "(aur"), t="Operação (AURora") is True
    assert one(text.contains_pattern("t", "aur.ra"), t="AURORA") is True
    assert one(text.contains_pattern("t", "x"), t=None) is False


def test_dates(one, spark):
    assert str(one(dates.parse_datetime("t"), t=" 01/02/2024 09h15 ")) == "2024-02-01 09:15:00"
    for bad in ("31/02/2024 09h15", "", "  ", None, "2024-02-01"):
        assert one(dates.parse_datetime("t"), t=bad) is None
    assert one(dates.year_month(F.col("t").cast("timestamp")), t=None) == "NaT"
    gap = dates.gap_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert one(gap, a="2024-01-02 12:00:00", b="2024-01-01 00:00:00") == 2  # -1.5 days is floored first
    assert one(gap, a="2024-01-01 00:00:00", b="2024-01-02 12:00:00") == 1
    assert one(gap, a=None, b="2024-01-02 12:00:00") is None


def test_bylines(one):
    hit = one(dates.parse_byline("t"), t="por  X — Publicado 01/02/2024 09h15 Notícia")
    assert (hit["publicado_em"], hit["data_publicacao"], hit["hora_publicacao"]) == ("01/02/2024 09h15", "01/02/2024", "09h15")
    miss = one(dates.parse_byline("t"), t="sem  data")
    assert (miss["publicado_em"], miss["data_publicacao"]) == ("sem data", None)
    assert one(dates.content_type("t"), t="a b  Notícia ") == "Notícia"
    both = one(dates.parse_article_dates("t"), t="Publicado em 01/02/2024 09h15 Atualizado em 02/02/2024 10h00")
    assert (both["published_at"], both["updated_at"]) == ("01/02/2024 09h15", "02/02/2024 10h00")
    assert one(dates.parse_article_dates("t"), t="publicado em 01/02/2024 09h15")["updated_at"] is None


def test_links(one):
    assert one(links.slug("u"), u="https://x.org/a/Fo%C3%A7a_B/?q=1#z") == "fo-c3-a7a_b"
    empty = "https://x.org/?q=1"
    assert one(links.slug("u"), u=empty) == "noticia-" + hashlib.md5(empty.encode()).hexdigest()[:10]
    url = "https://x.org/a/b"
    assert one(links.file_name("u"), u=url) == f"b-{hashlib.md5(url.encode()).hexdigest()[:8]}.md"
    assert one(links.resolve_path("p", "d", "u"), p=" ", u=url).startswith("d/b-")
    assert one(links.resolve_path("p", "d", "u"), p=" k.md ", u=url) == "k.md"
    assert one(links.page_number(F.col("n").cast("int")), n="119") == 2


def test_operation_names(one):
    cases = {
        "PF deflagra Operação Aurora em Recife": "Aurora",
        "Operação Estrela Guia fase 2": "Estrela Guia",
        "Operação Um Dois Três Quatro": "Um Dois Tres",
        "Operação em Recife": None,
        "Operação - em Recife": "Em Recife",
        "Operação -Luz- contra o crime": "Luz",
        "Operação Fase Nova": "Fase Nova",
        "PF apreende carga": None,
        None: None,
    }
    for title, name in cases.items():
        assert one(labels.operation_name("t"), t=title) == name, title


SENTENCES = {
    "lavagem_dinheiro": "Investigados por lavagem de dinheiro", "trafico_drogas": "apreensão de cocaína e maconha", "trafico_armas": "armas de fogo e munições",
    "crimes_ambientais": "garimpo ilegal na floresta", "crime_eleitoral": "compra de votos", "corrupcao_desvio": "a prefeitura foi alvo",
    "abuso_sexual_infantil": "pornografia infantil", "contrabando_descaminho": "contrabando de cigarros", "fraude_bancaria_cibernetica": "golpe por phishing",
    "trabalho_escravo_trafico_pessoas": "condições degradantes", "organizacao_criminosa": "organização criminosa", "falsidade_documental": "moeda falsa",
}


def test_every_crime_label(one):
    for label, sentence in SENTENCES.items():
        assert label in one(labels.keyword_labels(text.fold("t"), lexicon.CRIMES), t=sentence), label


def test_keywords_are_substrings_and_some_are_dead(one):
    assert one(labels.keyword_labels("t", lexicon.MODUS), t="visitei") == ["atuacao_online"]
    found = labels.keyword_labels(text.fold("t"), lexicon.CRIMES)
    assert one(found, t="facção criminosa") == []
    assert one(labels.keyword_labels(text.fold("t"), lexicon.corrected(lexicon.CRIMES)), t="facção criminosa") == ["organizacao_criminosa"]
    assert one(found, t=None) == []


def states(spark, title, subtitle="", tags="", body=""):
    df = spark.createDataFrame([(title, subtitle, tags, body)], "titulo string, subtitulo string, tags string, markdown_text string")
    row = ops.with_states(df).first()
    return row["ufs_mencionadas"], row["estados_mencionados"]


def test_state_rules(spark):
    assert states(spark, "PF em São Paulo")[0] == ["SP"]
    assert states(spark, "São Paulo de Olivença")[0] == []
    assert states(spark, "Ações para todos")[0] == []
    assert states(spark, "No estado do Pará")[0] == ["PA"]
    assert states(spark, "Em Mato Grosso do Sul") == (["MS", "MT"], ["Mato Grosso do Sul", "Mato Grosso"])
    assert states(spark, None, None, "Bahia | sp | Curitiba", "Hoje São Luís/MA e Lugar/XX")[0] == ["BA", "MA", "SP"]
    assert states(spark, "", "", "", "x" * 1300 + " Natal/RN")[0] == []


def test_geography_is_removed(one):
    got = one(geo.without_geography("t"), t="Hoje em São Paulo/SP, ações para 15 alvos de Mato Grosso do Sul se repetem")
    assert got == ", acoes alvos de repetem"
    assert one(geo.is_geographic_term("t"), t="rio branco") is True
    assert one(geo.is_geographic_term("t"), t="carga bahia") is True
    assert one(geo.is_geographic_term("t"), t="carga") is False


def test_series_labels(one):
    label = series.series_label("o", "c", "t", F.array(F.lit(4)))
    assert one(label, o=["A", "B", "C", "D"], c=["x"], t=["T"]) == "A | B | C"
    assert one(label, o=[], c=["x", "y", "z"], t=["T"]) == "serie_por_crime_x | y"
    assert one(label, o=[], c=[], t=["T" * 99]) == "T" * 90
    assert one(label, o=[], c=[], t=[]) == "serie_cluster_4"
    nothing = series.series_label("o", "c", "t", F.array().cast("array<int>"))
    assert one(nothing, o=[], c=[], t=[]) == "serie_sem_nome"
    key = series.series_key("o", "c", F.lit("Um título"))
    assert one(key, o=["Luz Azul", "B"], c=[]) == "operation::luz_azul_b"
    assert one(key, o=[], c=["x"]) == "crime::x"
    assert one(key, o=[], c=[]) == "label::um_t_tulo"
    shown = series.display_label(F.lit("L"), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), F.lit(None), F.lit(3), F.lit(9))
    assert one(shown, o=[]) == "L | 0-0 | c? | n=3 | id=9"


def test_series_strength(spark):
    rows = [(20, 1), (12, 5), (10, 4), (10, 3), (5, 1), (1, 3), (4, 2), (None, None)]
    got = spark.createDataFrame(rows, "size int, active_years int").select(series.series_strength().alias("s")).collect()
    assert [r["s"] for r in got] == ["Forte", "Forte", "Forte", "Média", "Média", "Média", "Fraca", "Fraca"]


def test_patterns_that_only_one_engine_accepts_are_literal(spark):
    df = spark.createDataFrame([("xa{y",), ("(?P<x>a)",), ("a++b{",), ("aab",)], "t string")
    hits = lambda p: [r["t"] for r in df.where(text.contains_pattern("t", p)).collect()]
    assert hits("a{") == ["xa{y"] and hits("(?P<x>a)") == ["(?P<x>a)"] and hits("a++b{") == ["a++b{"]
    assert hits("a+b") == ["aab"] and hits("A++B") == ["aab"]


def test_list_cells_with_both_quote_signs(one):
    assert one(text.unpack_list(F.col("c")), c="""["d'agua", 'x', 'a "b"']""") == ["d'agua", "x", 'a "b"']
    assert one(text.unpack_list(F.col("c")), c="[]") == [] and one(text.unpack_list(F.col("c")), c="['a', 'b|c']") == ["a", "b|c"]
    assert one(text.unpack_list(F.col("c")), c="[a|b") == ["[a", "b"] and one(text.unpack_list(F.col("c")), c=None) == []


def test_large_lexicons_give_the_labels_of_small_ones(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abc d", k=draw.randrange(1, 6))) for _ in range(400)]
    rules = {f"r{i}": draw.sample(words, 8) for i in range(50)} | {"all": [""], "none": ["zzz"], "shared": words[:3]}
    texts = [("".join(draw.choices("abc d", k=draw.randrange(0, 30))),) for _ in range(200)] + [(None,), ("",)]
    rows = spark.createDataFrame(texts, "t string")
    found = rows.select(labels.keyword_labels("t", rules, 10_000).alias("a"), labels.keyword_labels("t", rules, 0).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found) and any(len(r["a"]) > 3 for r in found)


def test_white_space_and_places_as_the_plain_patterns(spark):
    cases = ["a  b", " a b ", "a\n b", "a \u00a0\u2003b\x1c", "\t", " ", "", "a\x85b", "Rio Branco/AC", f"{'x' * 70}/SP", f"{'x y ' * 20}Natal/RN/BA", "é/PA", "a/AMa", "-'/SE", "½ ﬁ … ß \u2120"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select("t", text.collapse("t").alias("c"), F.regexp_extract_all("t", F.lit(geo.DATELINE), 1).alias("d"), text.fold("t").alias("f")).collect()
    plain = r"(?U)\b[\w' -]{2,60}/([A-Z]{2})\b"
    asked = df.select(
        F.trim(F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", " ")).alias("c"), F.regexp_extract_all("t", F.lit(plain), 1).alias("d")
    ).collect()
    assert [(r["c"], r["d"]) for r in got] == [(r["c"], r["d"]) for r in asked]
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
    assert [r["f"] for r in got] == [fold(r["t"]) for r in got]
