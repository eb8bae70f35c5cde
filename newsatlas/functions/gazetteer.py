"""The 27 states: names, capitals, coordinates, and the geography rules built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.text import collapse, fold, strip

# Uf, state, capital, latitude, longitude.
STATES: list[tuple[str, str, str, float, float]] = [
    ("AC", "Acre", "Rio Branco", -9.97499, -67.8243),
    ("AL", "Alagoas", "Maceio", -9.64985, -35.70895),
    ("AP", "Amapa", "Macapa", 0.03493, -51.0694),
    ("AM", "Amazonas", "Manaus", -3.11903, -60.0217),
    ("BA", "Bahia", "Salvador", -12.9718, -38.5011),
    ("CE", "Ceara", "Fortaleza", -3.73186, -38.5267),
    ("DF", "Distrito Federal", "Brasilia", -15.7797, -47.9297),
    ("ES", "Espirito Santo", "Vitoria", -20.3155, -40.3128),
    ("GO", "Goias", "Goiania", -16.6864, -49.2643),
    ("MA", "Maranhao", "Sao Luis", -2.53874, -44.2825),
    ("MT", "Mato Grosso", "Cuiaba", -15.6014, -56.0974),
    ("MS", "Mato Grosso do Sul", "Campo Grande", -20.4697, -54.6201),
    ("MG", "Minas Gerais", "Belo Horizonte", -19.9167, -43.9345),
    ("PA", "Para", "Belem", -1.45583, -48.5044),
    ("PB", "Paraiba", "Joao Pessoa", -7.11532, -34.861),
    ("PR", "Parana", "Curitiba", -25.4284, -49.2733),
    ("PE", "Pernambuco", "Recife", -8.05389, -34.8811),
    ("PI", "Piaui", "Teresina", -5.08917, -42.8019),
    ("RJ", "Rio de Janeiro", "Rio de Janeiro", -22.9068, -43.1729),
    ("RN", "Rio Grande do Norte", "Natal", -5.79448, -35.211),
    ("RS", "Rio Grande do Sul", "Porto Alegre", -30.0346, -51.2177),
    ("RO", "Rondonia", "Porto Velho", -8.76077, -63.8999),
    ("RR", "Roraima", "Boa Vista", 2.82384, -60.6753),
    ("SC", "Santa Catarina", "Florianopolis", -27.5949, -48.5482),
    ("SP", "Sao Paulo", "Sao Paulo", -23.5505, -46.6333),
    ("SE", "Sergipe", "Aracaju", -10.9472, -37.0731),
    ("TO", "Tocantins", "Palmas", -10.184, -48.3336),
]
NEIGHBOUR_PLACES = ["brasil", "paraguai", "argentina", "bolivia", "uruguai", "amazonia"]


def _by_initial(words: list[str]) -> str:
    """Alternation grouped by first letter, so that a word start tries few branches; order is kept inside."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


# Dateline and headline rules.
DATELINE = r"(?U)\b[\w' -]{2,60}+/([A-Z]{2})\b"  # what is taken never holds a slash, so none of it is given back
LEAD_CHARS = 1200  # the dateline rule looks at the opening of the article only
ALL = "Todos"

UFS = sorted(s[0] for s in STATES)
STATE_OF = {s[0]: s[1] for s in STATES}
PHRASES = sorted({s[1].lower() for s in STATES} | {s[2].lower() for s in STATES} | set(NEIGHBOUR_PLACES), key=lambda p: (-len(p), p))
TAG_KEYS = sorted({s[1].lower() for s in STATES} | {s[0].lower() for s in STATES} | {s[2].lower() for s in STATES})
TERM_KEYS = sorted({k.replace(" ", "_") for k in TAG_KEYS})
PLACE_OR_NUMBER = rf"\b(?:{_by_initial(PHRASES + [u.lower() for u in UFS])})\b|\d+"
HEADLINE_RULES = {uf: rf"\b{state.lower()}\b" for uf, state in STATE_OF.items()} | {
    "SP": r"\bsao paulo\b(?!\s+de\b)",
    "PA": r"\bestado do para\b",
}


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATES, "uf string, state string, capital string, lat double, lon double")


def state_choices(spark: SparkSession, column: str = "state") -> DataFrame:
    """Choices of a state or uf picker: the 'all' entry first, then the sorted values."""
    values = gazetteer(spark).select(F.col(column).alias("choice"), F.lit(1).alias("pos")).distinct()
    head = values.sparkSession.range(1).select(F.lit(ALL).alias("choice"), F.lit(0).alias("pos"))
    return head.unionByName(values).orderBy("pos", "choice").select("choice")


def state_names(ufs: Column | str) -> Column:
    """State names of a uf array; unknown codes are left out."""
    table = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])
    return F.array_compact(F.transform(as_col(ufs), lambda uf: F.try_element_at(table, uf)))


def mention_sources(title: Column | str, subtitle: Column | str, tags: Column | str, body: Column | str, lead_chars: int | None = LEAD_CHARS) -> Column:
    """What the state rules look at: folded headline (h), folded tags (t), dateline codes of the opening (d).

    Datelines beyond the first ``lead_chars`` characters are left out; None looks at the whole body.
    """
    blank = lambda c: F.coalesce(as_col(c), F.lit(""))
    return F.struct(
        fold(F.concat_ws(" ", blank(title), blank(subtitle))).alias("h"),
        F.transform(F.split(blank(tags), r"\|"), lambda t: fold(strip(t))).alias("t"),
        F.regexp_extract_all(blank(body) if lead_chars is None else F.left(blank(body), F.lit(lead_chars)), F.lit(DATELINE), 1).alias("d"),
    )


def state_mentions(sources: str) -> Column:
    """Sorted ufs named by an exact tag, by the headline, or by a dateline; ``sources`` names the struct column."""
    picks = [
        f"CASE WHEN array_contains({sources}.t, '{STATE_OF[uf].lower()}') OR array_contains({sources}.t, '{uf.lower()}') "
        f"OR {sources}.h RLIKE r'{HEADLINE_RULES[uf]}' OR array_contains({sources}.d, '{uf}') THEN '{uf}' END"
        for uf in UFS
    ]
    return F.expr(f"array_compact(array({', '.join(picks)}))")


def state_evidence(sources: str) -> Column:
    """The ufs that tags, headline and dateline name, each as an array: struct(tags, headline, dateline)."""
    named = lambda rule: F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {rule(uf)} THEN '{uf}' END" for uf in UFS) + "))")
    return F.struct(
        named(lambda uf: f"array_contains({sources}.t, '{STATE_OF[uf].lower()}') OR array_contains({sources}.t, '{uf.lower()}')").alias("tags"),
        named(lambda uf: f"{sources}.h RLIKE r'{HEADLINE_RULES[uf]}'").alias("headline"),
        named(lambda uf: f"array_contains({sources}.d, '{uf}')").alias("dateline"),
    )


def without_geography(text: Column | str) -> Column:
    """Text for the semantic space: datelines, place names, state codes and digits removed."""
    raw = as_col(text)
    # A dateline ends with two letters behind a slash, so nothing is looked for beyond the last slash and the sign after these.
    end = F.length(raw) - F.length(F.substring_index(raw, "/", -1)) + 3
    dated = F.concat(F.regexp_replace(F.left(raw, end), DATELINE, " "), F.substring(raw, end + 1, F.length(raw)))
    raw = F.when(raw.rlike("/[A-Z]{2}"), dated).otherwise(raw)
    return collapse(F.regexp_replace(fold(raw), PLACE_OR_NUMBER, " "))


def is_geographic_term(term: Column | str) -> Column:
    """A term that is, or has a word that is, a place name or state code."""
    t = as_col(term)
    whole = F.regexp_replace(t, "[^a-z0-9]+", "_")
    return F.btrim(whole, F.lit("_")).isin(TERM_KEYS) | F.exists(F.split(t, " "), lambda w: w.isin(TERM_KEYS))
