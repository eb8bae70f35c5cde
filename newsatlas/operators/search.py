"""Free-text and catalog search over character n-grams, and term trends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from newsatlas.functions.text import WS, fold, strip
from newsatlas.operators.gram_cells import LONGEST
from newsatlas.operators.gram_store import GramStore, spelled
from newsatlas.operators.keys import top_per_key
from newsatlas.operators.summaries import catalog_values, dual_map
from newsatlas.session import by_key, cut, scratch_dir

TEXT_GRAMS, CATALOG_GRAMS = (3, 5), (2, 5)
BROADCAST_GRAMS = 1_000_000  # distinct n-grams that a broadcast may hold
DIGITS = 6
TEXT, TAG, CRIME, MODUS = "Texto livre", "Tag", "Crime", "Modus"
YEAR, MONTH = "Ano", "Mes"


def word_grams(docs: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, gram, tf): character n-grams inside words, each word padded with one blank on both sides.

    The texts are partitioned by key once; both counts below then stay inside their partition. Each
    distinct word of a text is spelled out once, weighted by its count.
    """
    rows = by_key(docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text")), key)
    words = rows.select(key, F.explode(F.split("text", rf"(?U){WS}+")).alias("word")).where("word <> ''")
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    padded = counts.select(key, F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"), "n")
    sizes = padded.select(key, "w", "n", F.explode(F.array(*[F.lit(i) for i in range(low, high + 1)])).alias("size"))
    starts = sizes.where(F.length("w") >= F.col("size")).select(
        key, "w", "n", "size", F.explode(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1)).alias("at")
    )
    grams = starts.select(key, F.substring("w", F.col("at"), F.col("size")).alias("gram"), "n")
    return grams.groupBy(key, "gram").agg(F.sum("n").alias("tf"))


def gram_index(docs: DataFrame, key: str, text: str, grams: tuple[int, int] = TEXT_GRAMS) -> DataFrame:
    """(key, gram, weight, idf): unit-length TF-IDF rows. ``store_index`` writes them for searching.

    Up to BROADCAST_GRAMS distinct n-grams travel to the cells, which then stay in the partition of their text: neither
    the weights nor the lengths of the texts move a cell. More n-grams take the shuffled join.
    """
    cells = word_grams(docs, key, text, *grams)
    total = docs.agg(F.count(F.lit(1))).scalar()
    stats = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = cut(stats.select("gram", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")))
    raw = cells.join(F.broadcast(idf) if idf.count() <= BROADCAST_GRAMS else idf, "gram").select(key, "gram", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # the n-grams of one text
    return raw.select(key, "gram", (F.col("w") / norm).alias("weight"), "idf")


def store_index(docs: DataFrame, key: str, text: str, path: str | None = None, grams: tuple[int, int] = TEXT_GRAMS) -> GramStore:
    """The stored form of the index, in the shared folder when no path is given.

    Texts of one key count as one text. Plain texts are weighed in chunks, others cell by cell as ``gram_index`` does.
    """
    place = path or scratch_dir(docs.sparkSession, "grams")
    texts = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    if grams[0] >= 3 and grams[1] <= LONGEST:
        if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            texts = texts.groupBy(key).agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        stored = GramStore.write_texts(cut(texts.withColumn("no", F.monotonically_increasing_id())), docs.count(), place, key, grams)
        if stored is not None:
            return stored
    return GramStore.write(gram_index(docs, key, text, grams), place, key)


def query_grams(docs: DataFrame, value: str, grams: tuple[int, int]) -> DataFrame:
    """(gram, tf) of the query text: as many rows as the query has n-grams."""
    one = docs.sparkSession.range(1).select("id", strip(fold(F.lit(value))).alias("q"))
    return word_grams(one, "id", "q", *grams).select("gram", "tf")


def gram_scores(docs: DataFrame, key: str, text: str, value: str, grams: tuple[int, int] = TEXT_GRAMS) -> DataFrame:
    """(key, score): cosine between the query and every text that shares an n-gram with it."""
    return score_index(gram_index(docs, key, text, grams), key, query_grams(docs, value, grams))


def score_index(index: DataFrame, key: str, query: DataFrame) -> DataFrame:
    """Scores of a query against an index; the query side is tiny and is broadcast to the index scan."""
    hits = index.join(F.broadcast(query), "gram").select(key, "gram", "weight", (F.col("tf") * F.col("idf")).alias("q"))
    known = hits.groupBy("gram").agg(F.any_value("q").alias("q"))
    norm = known.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).scalar()
    return hits.groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("q")) / norm, DIGITS).alias("score"))


# Catalog terms ---------------------------------------------------------------------------------

def resolve_term(values: DataFrame, value: str) -> tuple[str, float]:
    """The catalog value meant by a text, and the score: 1 for an equal folded form, else the best cosine.

    ``values`` has one column ``value``, distinct. Ties go to the smallest value.
    """
    query = _query(values, value)
    if not query:
        return "", 0.0
    named = values.withColumn("key", fold("value"))
    exact = named.where(F.col("key") == query).agg(F.min("value").alias("v")).first()["v"]
    if exact is not None:
        return exact, 1.0
    scores = gram_scores(named, "value", "key", value, CATALOG_GRAMS)
    best = scores.orderBy(F.desc("score"), "value").limit(1).collect()
    if best:
        return best[0]["value"], float(best[0]["score"])
    first = values.agg(F.min("value").alias("v")).first()["v"]
    return (value, 0.0) if first is None else (first, 0.0)


def _query(df: DataFrame, value: str) -> str:
    return df.sparkSession.range(1).select(strip(fold(F.lit(value))).alias("q")).first()["q"]


# Signals ---------------------------------------------------------------------------------------

@dataclass
class Signal:
    """Rows that match a term, what the term was resolved to, and how well."""

    rows: DataFrame
    term: str
    resolved: str
    score: float
    scores: DataFrame | None = None  # (key, score) of a search by spelling


def similar(df: DataFrame, query: str, key: str, index: GramStore, floors: tuple[float, float], few: int, fallback: int) -> tuple[DataFrame, float]:
    """(key, score) of the rows that a misspelt text means, and the best score of all rows.

    Floors are tried from above, so that a search that is answered by strong hits never reads the long lists of weak ones.
    """
    grams = spelled(query, *TEXT_GRAMS)
    for floor in (*floors, 0.0):
        scores = cut(index.scores(grams, floor).join(df.select(key), key, "left_semi"))
        facts = scores.agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n")).first()
        if floor == floors[0] and facts["n"] >= few:
            return scores, facts["top"]
        if floor != floors[0] and facts["n"]:
            break
    best = scores.orderBy(F.desc("score"), key).limit(fallback).where(F.col("score") >= floors[1])
    return best, float(facts["top"] or 0.0)


def fuzzy_text(
    df: DataFrame, value: str, key: str = "link", index: GramStore | None = None,
    floor: float = 0.20, few: int = 12, fallback: int = 150, fallback_floor: float = 0.10,
) -> Signal:
    """Rows that hold the text; when there is none, rows with a similar spelling.

    Fewer than ``few`` rows above the floor are replaced by the best ``fallback`` rows above the lower
    floor. ``index`` is the stored n-gram index of the whole corpus; without it the rows index themselves.
    """
    query = _query(df, value)
    if not query:
        return Signal(df.where(F.lit(False)), value, value, 0.0)
    exact = df.where(F.contains(F.col("texto_busca_normalizado"), F.lit(query)))
    if not exact.isEmpty():
        return Signal(exact, value, value, 1.0)
    base = store_index(df, key, "texto_busca_normalizado") if index is None else index
    scores, top = similar(df, query, key, base, (floor, fallback_floor), few, fallback)
    return Signal(df.join(scores.select(key), key, "left_semi"), value, f"{value} (aproximado)", top, scores)


def match_signal(df: DataFrame, mode: str, value: str, key: str = "link", index: GramStore | None = None, corpus: DataFrame | None = None) -> Signal:
    """Rows that match one term as free text, tag, crime or modus.

    The catalog of tags and labels is that of ``corpus``, the whole collection, when it is given.
    """
    if mode == TEXT:
        return fuzzy_text(df, value, key, index)
    columns = {TAG: "tags_list", CRIME: "crime_labels", MODUS: "modus_labels"}
    resolved, score = resolve_term(catalog_values(df if corpus is None else corpus, columns[mode]), value) if mode in columns else ("", 0.0)
    if not resolved:
        return Signal(df.where(F.lit(False)), value, value, 0.0)
    wanted = _query(df, resolved)
    rows = df.where(F.exists(columns[mode], lambda v: fold(v) == wanted))
    return Signal(rows, value, resolved, score)


def signal_trend(df: DataFrame, signals: list[Signal], period: str = YEAR) -> DataFrame:
    """Per term and period: rows of the period, mentions, share and 0-100 index."""
    col, name = ("ano", "year") if period == YEAR else ("ano_mes", "month")
    totals = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("total_periodo"))
    parts = None
    for s in signals:
        hits = s.rows.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("citacoes"))
        part = totals.join(hits, name, "left").fillna(0, ["citacoes"]).withColumns(
            {"termo": F.lit(s.term), "termo_resolvido": F.lit(s.resolved), "score_busca": F.lit(round(s.score, 4))}
        )
        parts = part if parts is None else parts.unionByName(part)
    peak = F.greatest(F.max("citacoes").over(Window.partitionBy("termo")), F.lit(1))  # one row per period
    return parts.withColumns(
        {"share": F.col("citacoes") / F.col("total_periodo"), "indice_google_like": F.col("citacoes") / peak * 100}
    )


def trend_peak(trend: DataFrame, name: str = "year") -> DataFrame:
    """Best period of each term, the earliest on a tie."""
    best = top_per_key(trend, ["termo"], [F.desc("citacoes"), F.asc(name)])
    return best.select(
        "termo", F.col("termo_resolvido").alias("busca_resolvida"), "score_busca", F.col(name).alias("pico_periodo"),
        F.col("citacoes").alias("pico_citacoes"), F.col("share").alias("share_no_pico"),
    )


def dual_compare(
    df: DataFrame, a: str, b: str, mode: str = TEXT, period: str = YEAR, key: str = "link",
    index: GramStore | None = None, corpus: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trend, peak table and two-sided map of two terms; a blank term is left out.

    ``df`` may be filtered; ``index`` and ``corpus`` are the n-gram index and the rows of the whole collection, from
    which misspelt terms are resolved.
    """
    found = [match_signal(df, mode, t, key, index, corpus) if t and t.strip() else None for t in (a, b)]
    trend = signal_trend(df, [s for s in found if s is not None], period) if any(found) else None
    sides = [s.rows if s is not None else df.where(F.lit(False)) for s in found]
    if trend is None:
        blank = Signal(df.where(F.lit(False)), "", "", 0.0)
        trend = signal_trend(df, [blank], period).where(F.lit(False))
    return trend, trend_peak(trend, "year" if period == YEAR else "month"), dual_map(*sides)
