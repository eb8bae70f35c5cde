"""Rule dictionaries and stop words.

Fixed values: these lists decide the labels, so they are stated as they must match. Keywords are in
folded form. Forms that no correctly encoded text contains (such as 'facaao criminosa') are part of
the fixed values; ``CORRECTED`` adds the readable spelling for the two ideas that only have such forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values -------------------------------------------------------------------------------
CRIMES: dict[str, list[str]] = {
    "lavagem_dinheiro": ["lavagem de dinheiro", "lavagem de capitais", "ocultacao de bens", "ocultaaao de bens", "evasao de divisas"],
    "trafico_drogas": ["trafico de drogas", "entorpecentes", "maconha", "cocaina", "cocaana", "crack"],
    "trafico_armas": ["trafico de armas", "armas de fogo", "municoes", "muniaaes"],
    "crimes_ambientais": ["crime ambiental", "crimes ambientais", "garimpo ilegal", "desmatamento", "pesca ilegal", "extraaao ilegal", "extracao ilegal", "madeira ilegal", "ibama", "icmbio"],
    "crime_eleitoral": ["crime eleitoral", "crimes eleitorais", "sufragio", "compra de votos"],
    "corrupcao_desvio": ["corrupcao", "corrupaao", "desvio de recursos", "desvio de verbas", "licitacao", "licitaaao", "peculato", "prefeitura"],
    "abuso_sexual_infantil": ["abuso sexual infantojuvenil", "abuso sexual de criancas", "abuso sexual de crianaas", "pornografia infantil", "exploracao sexual infantil", "exploraaao sexual infantil", "pedofilia"],
    "contrabando_descaminho": ["contrabando", "descaminho", "cigarros falsificados", "cigarro falsificado", "mercadoria estrangeira", "importacao irregular", "importaaao irregular"],
    "fraude_bancaria_cibernetica": ["fraude bancaria", "fraudes bancarias", "golpe", "crime cibernetico", "crime cibernatico", "phishing", "internet banking"],
    "trabalho_escravo_trafico_pessoas": ["trabalho escravo", "trabalho analogo ao de escravo", "trafico de pessoas", "condicoes degradantes", "condiaaes degradantes"],
    "organizacao_criminosa": ["organizacao criminosa", "organizaaao criminosa", "facaao criminosa", "associacao criminosa", "associaaao criminosa", "milicia", "milacia"],
    "falsidade_documental": ["falsidade ideologica", "falsidade ideola3gica", "documento falso", "passaporte falso", "moeda falsa", "certidao falsa"],
}

MODUS: dict[str, list[str]] = {
    "busca_apreensao": ["busca e apreensao", "mandado de busca", "mandados de busca"],
    "prisao": ["prisao preventiva", "prisao temporaria", "mandado de prisao", "flagrante"],
    "bloqueio_bens": ["bloqueio de bens", "sequestro de bens", "indisponibilidade de bens", "bloqueio judicial"],
    "fiscalizacao": ["fiscalizacao", "fiscalizaaao", "inspecao", "inspeaao", "vistoria"],
    "atuacao_online": ["internet", "rede social", "whatsapp", "telegram", "site", "online"],
    "cooperacao_interagencias": ["ficco", "ibama", "receita federal", "funai", "prf", "cgu", "controladoria-geral da uniao", "gaeco", "forca integrada", "foraa integrada"],
    "fronteira_transnacional": ["fronteira", "paraguai", "bolivia", "bolavia", "argentina", "internacional", "transnacional"],
    "resgate_vitimas": ["resgate", "vitimas", "vatimas", "trabalhadores resgatados", "pessoas resgatadas"],
    "desarticulacao_rede": ["desarticular", "desarticulaaao", "esquema criminoso", "quadrilha", "rede criminosa"],
    "combate_financeiro": ["movimentacao financeira", "movimentaaao financeira", "contas bancarias", "sigilo bancario"],
}

CORRECTED: dict[str, list[str]] = {
    "organizacao_criminosa": ["faccao criminosa"],
    "desarticulacao_rede": ["desarticulacao"],
}

STOP_WORDS: list[str] = [
    "a", "ao", "aos", "aquela", "aquelas", "aquele", "aqueles", "aquilo", "as", "ate", "com", "como", "contra", "da",
    "das", "de", "dela", "dele", "deles", "demais", "depois", "do", "dos", "e", "ela", "elas", "ele", "eles", "em",
    "entre", "era", "eram", "essa", "essas", "esse", "esses", "esta", "estao", "estar", "estas", "estava", "este",
    "estes", "foi", "foram", "ha", "isso", "isto", "ja", "la", "lhe", "lhes", "mais", "mas", "mesmo", "na", "nas",
    "nao", "nem", "no", "nos", "nossa", "nosso", "nossos", "num", "numa", "o", "os", "ou", "para", "pela", "pelas",
    "pelo", "pelos", "por", "qual", "quando", "que", "quem", "se", "sem", "ser", "seu", "seus", "sido", "sob",
    "sobre", "sua", "suas", "tal", "tambem", "te", "tem", "tendo", "ter", "teve", "tipo", "toda", "todas", "todo",
    "todos", "um", "uma", "umas", "uns", "vos", "policia", "federal", "pf", "operacao", "operacoes", "noticia",
    "noticias",
]

OPERATION_STOP_WORDS: list[str] = ["em", "no", "na", "nos", "nas", "contra", "para", "com", "do", "da", "de", "e"]
OPERATION_PHASE_WORDS: list[str] = ["fase", "fases"]
# --------------------------------------------------------------------------------------------


def corrected(rules: dict[str, list[str]]) -> dict[str, list[str]]:
    """The same rules with the readable spellings added."""
    return {label: words + CORRECTED.get(label, []) for label, words in rules.items()}


def lexicon_table(spark: SparkSession, crimes: dict = CRIMES, modus: dict = MODUS) -> DataFrame:
    """Both dictionaries as rows (taxonomy, label, keyword, seq)."""
    rows = [
        (taxonomy, label, keyword, seq)
        for taxonomy, rules in (("crime", crimes), ("modus", modus))
        for seq, (label, keyword) in enumerate((l, k) for l, ks in rules.items() for k in ks)
    ]
    return spark.createDataFrame(rows, "taxonomy string, label string, keyword string, seq int")
