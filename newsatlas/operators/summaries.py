"""Counts by year, state, label and cluster; temporal recurrence; cluster profiles.

Everything is counted before it is shuffled on: partial aggregation inside each input partition keeps
hot years, labels and clusters small. No window runs over raw rows of a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsatlas.functions import gazetteer as geo
from newsatlas.functions.text import fold, normalize_label, strip
from newsatlas.operators.keys import ranked_list, top_per_key


def articles() -> Column:
    return F.count(F.lit(1)).alias("noticias")


def _places(spark: SparkSession) -> DataFrame:
    return F.broadcast(geo.gazetteer(spark).select("uf", "state", "lat", "lon"))  # 27 rows


def labels_by_year(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per (ano, label); rows without a year are left out."""
    rows = df.where("ano IS NOT NULL").select("ano", F.explode(column).alias(name))
    return rows.groupBy("ano", name).agg(articles()).orderBy("ano", F.desc("noticias"), name)


def states_by(df: DataFrame, key: str, column: str = "ufs_mencionadas") -> DataFrame:
    """Rows per (key, uf) with the state's name and place; ``key`` is ano or cluster_id."""
    rows = df.where(F.col(key).isNotNull()).select(key, F.explode(column).alias("uf"))
    counts = rows.groupBy(key, "uf").agg(articles())
    placed = counts.join(_places(df.sparkSession), "uf")
    return placed.select(key, "uf", "state", "lat", "lon", "noticias").orderBy(key, F.desc("noticias"), "uf")


def clusters_by_year(df: DataFrame) -> DataFrame:
    keys = ["ano", "cluster_id", "cluster_label"]
    rows = df.where("ano IS NOT NULL AND cluster_id IS NOT NULL AND cluster_label IS NOT NULL")
    return rows.groupBy(*keys).agg(articles()).orderBy("ano", F.desc("noticias"), "cluster_id")


def crime_state_year(df: DataFrame, labels: str = "crime_labels", ufs: str = "ufs_mencionadas") -> DataFrame:
    """Each label of an article counted in each state of the article."""
    rows = df.where("ano IS NOT NULL").select("ano", F.explode(labels).alias("crime_label"), ufs)
    rows = rows.select("ano", "crime_label", F.explode(ufs).alias("uf"))
    counts = rows.groupBy("ano", "crime_label", "uf").agg(articles())
    named = counts.join(_places(df.sparkSession).select("uf", "state"), "uf")
    return named.select("ano", "crime_label", "uf", "state", "noticias").orderBy("ano", "crime_label", F.desc("noticias"), "uf")


def crime_map(summary: DataFrame, crime: str, year: int | None = None) -> DataFrame:
    """One crime by state, for one year or summed over all."""
    rows = summary.where(F.col("crime_label") == crime)
    if year is not None:
        rows = rows.where(F.col("ano") == year)
    return rows.groupBy("crime_label", "uf", "state").agg(F.sum("noticias").alias("noticias"))


def map_peak(by_state: DataFrame) -> DataFrame:
    """Leading state, its count, and the total."""
    total = F.sum("noticias").over(Window.partitionBy())  # at most 27 rows
    ranked = by_state.withColumn("total", total).orderBy(F.desc("noticias"), "uf").limit(1)
    return ranked.select("state", F.col("noticias").alias("pico"), "total")


def states_from_corpus(df: DataFrame, column: str = "ufs_mencionadas") -> DataFrame:
    """State counts with their share of the largest count and the map radius."""
    counts = df.select(F.explode(column).alias("uf")).groupBy("uf").agg(articles())
    placed = counts.join(_places(df.sparkSession), "uf")
    peak = F.greatest(F.max("noticias").over(Window.partitionBy()), F.lit(1))  # at most 27 rows
    return placed.select(
        "uf", "state", "lat", "lon", "noticias",
        (F.pow(F.greatest("noticias", F.lit(1)), 0.7) * 4000).alias("radius"),
        (F.col("noticias") / peak).alias("share"),
    ).orderBy(F.desc("noticias"), "uf")


def dual_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two state counts side by side, sized against the larger of both peaks."""
    keys = ["uf", "state", "lat", "lon"]
    left = states_from_corpus(a).select(*keys, F.col("noticias").alias("noticias_a"))
    right = states_from_corpus(b).select(*keys, F.col("noticias").alias("noticias_b"))
    both = left.join(right, keys, "full_outer").fillna(0, ["noticias_a", "noticias_b"])
    everything = Window.partitionBy()  # at most 27 rows
    peak = F.greatest(F.max("noticias_a").over(everything), F.max("noticias_b").over(everything), F.lit(1))
    radius = lambda c: F.pow(F.col(c) / peak, 0.72) * 240000
    return both.select(
        *keys, "noticias_a", "noticias_b", (F.col("noticias_a") + F.col("noticias_b")).alias("total"),
        radius("noticias_a").alias("radius_a"), radius("noticias_b").alias("radius_b"),
    ).orderBy(F.desc("total"), "uf")


def paint_polygons(polygons: DataFrame, counts: DataFrame) -> DataFrame:
    """Every polygon with its count (0 when absent) and its ratio to the largest count.

    ``counts`` has one row per uf, so it is small enough to broadcast.
    """
    joined = polygons.join(F.broadcast(counts.select("uf", "noticias")), "uf", "left").fillna(0, ["noticias"])
    drawn = counts.join(polygons.select("uf").distinct(), "uf", "left_semi")
    peak = drawn.agg(F.max("noticias")).scalar()
    return joined.withColumn("ratio", F.when(peak > 0, F.col("noticias") / peak).otherwise(F.lit(0.0)))


def monthly_volume(df: DataFrame, *keys: str, month: str = "ano_mes") -> DataFrame:
    return df.groupBy(*keys, F.col(month).alias("month")).agg(articles()).orderBy(*keys, "month")


def label_totals(by_year: DataFrame, name: str) -> DataFrame:
    return by_year.groupBy(name).agg(F.sum("noticias").alias("noticias")).orderBy(F.desc("noticias"), name)


def overview(corpus: DataFrame, series: DataFrame, pairs: DataFrame) -> DataFrame:
    """Corpus size, clusters, series, pairs and the span of years, in one row."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return corpus.agg(
        articles(), F.count_distinct("cluster_id").alias("clusters"), F.min("ano").alias("ano_min"), F.max("ano").alias("ano_max")
    ).select("noticias", "clusters", count(series).alias("series"), count(pairs).alias("pares"), "ano_min", "ano_max")


def catalog_values(df: DataFrame, column: str) -> DataFrame:
    values = df.select(F.explode(column).alias("value")).where("value <> ''")
    return values.distinct().orderBy("value")


# Top values ------------------------------------------------------------------------------------

def top_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, [group], [F.desc("n"), F.asc(value)], k)


def modes(df: DataFrame, group: str, value: str, keep: int = 3) -> DataFrame:
    """All most frequent values of each group, smallest first, at most ``keep`` of them.

    The largest count is found by aggregation, so the many ties of a hot group never meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    peak = counts.groupBy(group).agg(F.max("n").alias("n"))
    tied = counts.join(peak, [group, "n"], "left_semi")
    return top_per_key(tied, [group], [F.asc(value)], keep)


def first_titles(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Earliest titles of each group; undated articles come last."""
    order = [F.col("data_publicacao_dt").asc_nulls_last(), F.col("link")]
    return top_per_key(df.select(group, "link", "titulo", "data_publicacao_dt"), [group], order, k)


def profile(df: DataFrame, group: str, kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """Per group, the top values of several array columns at once: {kind: (array, k)}.

    One count over (group, kind, value) and one ranked window serve all kinds. Result columns hold
    arrays in rank order.
    """
    tagged = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    items = F.concat(*[F.transform(arr, tagged(kind)) for kind, (arr, _) in kinds.items()])
    counts = df.select(group, F.inline(items)).groupBy(group, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    most = max(k for _, k in kinds.values())
    best = top_per_key(counts, [group, "kind"], [F.desc("n"), F.asc("value")], most)
    picks = [
        ranked_list("value", when=(F.col("kind") == kind) & (F.col("rank") <= k)).alias(kind) for kind, (_, k) in kinds.items()
    ]
    return best.groupBy(group).agg(*picks)


def own_tags(tags: str = "tags") -> Column:
    """Tags of a packed cell that do not name a place."""
    parts = F.transform(F.split(F.coalesce(F.col(tags), F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda t: (t != "") & ~fold(t).isin(geo.TAG_KEYS))


def span_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("size"),
        F.min("data_publicacao_dt").alias("first_date"),
        F.max("data_publicacao_dt").alias("last_date"),
        F.count_distinct("ano").cast("int").alias("active_years"),
    ]


def cluster_summary(df: DataFrame, top_terms: DataFrame | None = None) -> DataFrame:
    """Profile of each cluster. ``top_terms`` holds (cluster_id, top_terms array)."""
    group = "cluster_id"
    rows = df.where("cluster_id IS NOT NULL")
    spans = rows.groupBy(group).agg(*span_columns())
    kinds = {
        "top_tags": (own_tags(), 8),
        "top_states": (F.col("ufs_mencionadas"), 6),
        "top_crimes": (F.col("crime_labels"), 6),
        "top_modus": (F.col("modus_labels"), 6),
    }
    tops = profile(rows, group, kinds)
    titles = first_titles(rows, group).groupBy(group).agg(ranked_list("titulo").alias("sample_titles"))
    if top_terms is None:
        top_terms = spans.select(group, F.array().cast("array<string>").alias("top_terms"))
    joined = spans.join(tops, group, "left").join(titles, group, "left").join(top_terms, group, "left")
    packed = lambda c, sep=" | ": F.coalesce(F.array_join(c, sep), F.lit("")).alias(c)
    label = F.concat(
        F.lit("cluster_"), F.col(group).cast("string"), F.lit("_"),
        normalize_label(F.coalesce(F.array_join(F.slice("top_terms", 1, 4), " "), F.lit(""))),
    )
    return joined.select(
        group, "size", "first_date", "last_date", "active_years", packed("top_terms"), packed("top_tags"),
        F.coalesce(F.array_join(geo.state_names("top_states"), " | "), F.lit("")).alias("top_states"),
        packed("top_crimes"), packed("top_modus"), packed("sample_titles", " || "), label.alias("cluster_label"),
    ).orderBy(F.desc("size"), group)


def gap_counts(df: DataFrame, group: str = "cluster_id") -> DataFrame:
    """How often each gap, in whole days, lies between consecutive dates of a group.

    Dates are first reduced to one row per (group, day): inside a day every gap is 0, and between days
    only the last and first instants matter. The window then sees days, not articles.
    """
    ts = F.col("data_publicacao_dt")
    days = (
        df.where(ts.isNotNull() & F.col(group).isNotNull())
        .groupBy(group, F.to_date(ts).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    )
    before = F.lag("hi").over(Window.partitionBy(group).orderBy("day"))
    gap = F.floor((F.unix_timestamp("lo") - F.unix_timestamp(before)) / F.lit(86400))
    within = F.struct(F.lit(0).cast("bigint").alias("gap_days"), (F.col("n") - 1).alias("n"))
    between = F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("bigint").alias("n"))
    rows = days.withColumn("gap", gap).select(group, F.inline(F.array(within, between)))
    return rows.where("gap_days IS NOT NULL AND n > 0").groupBy(group, "gap_days").agg(F.sum("n").alias("n"))


def gap_stats(df: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Median and mean gap per group, from the counted gaps."""
    counts = gap_counts(df, group)
    run = F.sum("n").over(Window.partitionBy(group).orderBy("gap_days"))
    total = F.sum("n").over(Window.partitionBy(group))
    placed = counts.select(group, "gap_days", "n", run.alias("upto"), total.alias("total"))
    reach = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("gap_days")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    return placed.groupBy(group).agg(
        F.round((reach(low) + reach(high)) / 2, 2).alias("median_gap_days"),
        F.round(F.sum(F.col("gap_days") * F.col("n")) / F.sum("n"), 2).alias("mean_gap_days"),
    )


def peaks(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group and its count; the smallest value wins a tie."""
    return top_values(df, group, value, 1).select(group, F.col(value).alias("peak"), F.col("n").alias("peak_count"))


def temporal_recurrence(df: DataFrame) -> DataFrame:
    """Activity, peaks and gaps of each cluster."""
    g = "cluster_id"
    rows = df.where("cluster_id IS NOT NULL")
    cells = rows.groupBy(g, "ano", "mes", "ano_mes").agg(F.count(F.lit(1)).alias("n"))  # bounded by the calendar
    base = cells.groupBy(g).agg(
        F.sum("n").alias("noticias"), F.count_distinct("ano").cast("int").alias("active_years"),
        F.count_distinct("ano_mes").cast("int").alias("active_months"),
    )
    month = top_per_key(cells.groupBy(g, "ano_mes").agg(F.sum("n").alias("n")), [g], [F.desc("n"), F.asc("ano_mes")])
    calendar = top_per_key(
        cells.where("mes IS NOT NULL").groupBy(g, "mes").agg(F.sum("n").alias("n")), [g], [F.desc("n"), F.asc("mes")]
    )
    month = month.select(g, F.col("ano_mes").alias("peak_year_month"), F.col("n").alias("peak_year_month_count"))
    calendar = calendar.select(g, F.col("mes").alias("peak_calendar_month"), F.col("n").alias("peak_calendar_month_count"))
    joined = base.join(month, g, "left").join(calendar, g, "left").join(gap_stats(rows, g), g, "left")
    return joined.select(
        g, "noticias", "active_years", "active_months", "peak_year_month", "peak_year_month_count", "peak_calendar_month",
        F.coalesce("peak_calendar_month_count", F.lit(0)).alias("peak_calendar_month_count"),
        F.round(F.col("peak_calendar_month_count") / F.col("noticias"), 4).alias("peak_calendar_month_share"),
        "median_gap_days", "mean_gap_days", (F.col("active_years") >= 3).alias("repeats_across_years"),
    ).orderBy(F.desc("repeats_across_years"), F.desc("noticias"), g)


# Top-k reports ---------------------------------------------------------------------------------

def keep_top_labels(by_year: DataFrame, name: str, k: int = 8) -> DataFrame:
    """Yearly rows of the k labels with the largest totals."""
    return by_year.join(F.broadcast(label_totals(by_year, name).limit(k)), name, "left_semi")


def state_trend(summary: DataFrame, crime: str, k: int = 5) -> DataFrame:
    """Yearly rows of one crime in its k leading states."""
    rows = summary.where(F.col("crime_label") == crime)
    return keep_top_labels(rows, "uf", k)


def top_examples(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """Earliest titles holding each label, for all labels at once."""
    rows = df.select("link", "titulo", "data_publicacao_dt", F.explode(column).alias("label"))
    return first_titles(rows, "label", k)


def recurring_clusters(temporal: DataFrame, k: int = 10) -> DataFrame:
    return temporal.where("repeats_across_years").orderBy(F.desc("noticias"), "cluster_id").limit(k)


def recent(df: DataFrame, k: int, newest_first: bool = True) -> DataFrame:
    stamp = F.col("data_publicacao_dt")
    return df.orderBy(stamp.desc_nulls_last() if newest_first else stamp.asc_nulls_last(), "link").limit(k)
