"""Queries over the semantic space, neighbours, series and the cluster network (sem_*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsatlas.operators import graph, neighbours as near, network, semantic as sem, summaries as sm
from newsatlas.plans.catalog import views as v
from newsatlas.plans.catalog.registry import query, stage
from newsatlas.plans.catalog.views import sql

TERM_CTES = {
    "tf": ("SELECT doc_id, link, term, count(*) AS tf FROM (SELECT doc_id, link, unnest(terms) AS term FROM tok) GROUP BY ALL", ["tok"]),
    "vocab": (
        "SELECT term, n, df, ln((1.0 + n_docs) / (1.0 + df)) + 1 AS idf FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term), "
        "(SELECT count(*) AS n_docs FROM tok) WHERE df >= 3 AND df <= 0.80 * n_docs ORDER BY n DESC, term LIMIT 40000",
        ["tf", "tok"],
    ),
    "weights": (
        "SELECT doc_id, link, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, link, term, tf * idf AS w FROM tf JOIN vocab USING (term))",
        ["tf", "vocab"],
    ),
    "cmean": (
        "SELECT cluster_id, term, round(sum(weight) / any_value(size), 6) AS mean FROM weights JOIN cor USING (link) JOIN "
        "(SELECT cluster_id, count(*) AS size FROM cor GROUP BY 1) USING (cluster_id) GROUP BY cluster_id, term",
        ["weights", "cor"],
    ),
    "c_terms": (
        "SELECT cluster_id, list(term ORDER BY rn) AS vals FROM (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, term) AS rn FROM cmean "
        f"WHERE regexp_replace(term, '[^a-z0-9]+', '_', 'g') NOT IN {v.words_sql(v.geo.TERM_KEYS)} AND len([w for w in string_split(term, ' ') if w IN {v.words_sql(v.geo.TERM_KEYS)}]) = 0) WHERE rn <= 10 GROUP BY cluster_id",
        ["cmean"],
    ),
}


BROADCAST_ROWS = 1_000_000  # (link, cluster_id) rows that may travel to the vectors, which then need not move


@stage("words")
def word_lists(spark, d):
    return sem.word_lists(v.labelled(spark, d).select("doc_id", "link", "texto_ponderado")).drop("texto_ponderado")


def terms(spark, d):
    """Words and pairs of words of all news. Only the words are stored, the pairs are made where they are read."""
    return word_lists(spark, d).withColumn("terms", sem.with_bigrams("words")).drop("words")


@stage("tfidf", write=None)
def fitted(spark, d):
    return sem.fit_tfidf(terms(spark, d))


def cluster_top_terms(spark, d):
    clusters = v.corpus(spark, d).select("link", "cluster_id")
    rows = vectors(spark, d).join(F.broadcast(clusters) if clusters.count() <= BROADCAST_ROWS else clusters, "link")
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sem.top_terms(fitted(spark, d).weights(rows, "cluster_id"), sizes)


@query("sem_tokens", sql("SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, md5(array_to_string(terms, '|')) AS digest FROM tok", "tok"))
def tokens(spark, d):
    rows = sem.tokens(v.enriched(spark, d))
    return rows.select("doc_id", F.size("terms").alias("n"), F.md5(F.array_join("terms", "|")).alias("digest"))


@query("sem_vocabulary", sql("SELECT term, n AS tf, df, round(idf, 6) AS idf FROM vocab", "vocab", **TERM_CTES))
def vocabulary(spark, d):
    docs = terms(spark, d)
    return sem.vocabulary(sem.term_stats(docs), docs.count()).withColumn("idf", F.round("idf", 6))


@query(
    "sem_tfidf",
    sql("SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top, min(term) AS first_term FROM weights GROUP BY doc_id", "weights", **TERM_CTES),
)
def tfidf(spark, d):
    rows = fitted(spark, d).rows(terms(spark, d), "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"), F.min("term").alias("first_term")
    )


@query("sem_top_terms", sql("SELECT cluster_id, array_to_string(vals, '|') AS top_terms FROM c_terms", "c_terms", **TERM_CTES))
def top_terms(spark, d):
    return cluster_top_terms(spark, d)


# Clustering depends on starting points; its queries return what is determined.
@stage("tfidf_vectors")
def vectors(spark, d):
    return fitted(spark, d).vectors(terms(spark, d)).select("link", "tfidf")


@stage("decomposition", write=None)
def decomposed(spark, d):
    return sem.decompose_vectors(vectors(spark, d))


@stage("reduced")
def reduced(spark, d):
    return sem.project(vectors(spark, d), "link", decomposed(spark, d))


POWERS = 24


def power_ctes(cells: str, rounds: int) -> dict:
    """The leading singular pair of the rows of ``cells`` (link, term, weight): CTEs ``x<rounds>`` (link, x) and ``lead``."""
    out = {"x0": (f"SELECT link, 1.0 AS x FROM {cells} GROUP BY link", [cells])}
    for i in range(1, rounds + 1):
        out[f"y{i}"] = (f"SELECT term, sum(weight * x) AS y FROM {cells} JOIN x{i - 1} USING (link) GROUP BY term", [cells, f"x{i - 1}"])
        out[f"z{i}"] = (f"SELECT link, sum(weight * y) AS z FROM {cells} JOIN y{i} USING (term) GROUP BY link", [cells, f"y{i}"])
        out[f"x{i}"] = (f"SELECT link, z / (SELECT sqrt(sum(z * z)) FROM z{i}) AS x FROM z{i}", [f"z{i}"])
    out["lead"] = (f"SELECT sqrt(sum(y * y)) AS s FROM (SELECT term, sum(weight * x) AS y FROM {cells} JOIN x{rounds} USING (link) GROUP BY term)", [cells, f"x{rounds}"])
    return out


@query(
    "sem_svd",
    sql(
        "SELECT t.link, least(160, greatest(2, (SELECT count(*) FROM vocab) - 1)) AS dims, CAST(w.link IS NOT NULL AS DOUBLE) AS norm, "
        f"round((SELECT s FROM lead), 4) AS largest, round(coalesce(w.x, 0) * (SELECT s FROM lead), 3) AS first, TRUE AS settled FROM tok t LEFT JOIN x{POWERS} w USING (link)",
        "tok", "vocab", f"x{POWERS}", "lead", **{**TERM_CTES, **power_ctes("weights", POWERS)},
    ),
)
def svd(spark, d):
    """Length of each reduced row, the largest singular value, the rows on its direction, and whether all pairs are settled."""
    found = decomposed(spark, d)
    lead = sem.Decomposition(found.basis[:, :1], found.values[:1], found.residuals[:1], found.rounds)
    first = sem.project(vectors(spark, d), "link", lead, unit=False).select("link", F.round(F.abs(F.col("vec")[0]), 3).alias("first"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = reduced(spark, d).select("link", F.size("vec").alias("dims"), F.round(norm, 6).alias("norm"))
    settled = bool(found.residuals.max() <= sem.TOLERANCE)
    return rows.join(first, "link").withColumns({"largest": F.lit(round(float(found.values[0]), 4)), "settled": F.lit(settled)})


@query(
    "sem_silhouette",
    sql(
        "SELECT count(*) AS rows, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM (SELECT link, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM "
        "(SELECT p.link, q.cluster_id = p.cluster_id AS own, sum(1 - list_dot_product(p.v, q.v) / (p.len * q.len)) / (count(*) - CASE WHEN q.cluster_id = p.cluster_id THEN 1 ELSE 0 END) AS d "
        "FROM (SELECT u.*, c.cluster_id FROM unitv u JOIN cor c USING (link)) p, (SELECT u.*, c.cluster_id FROM unitv u JOIN cor c USING (link)) q GROUP BY p.link, p.cluster_id, q.cluster_id) GROUP BY link)",
        "unitv", "cor",
    ),
)
def silhouette(spark, d):
    """How well the given groups of the given vectors stand apart."""
    rows = v.corpus(spark, d)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(round(sem.silhouette(rows), 5)).alias("silhouette"))


@stage("silhouettes")
def silhouettes(spark, d):
    best, scores = sem.choose_k(reduced(spark, d), "link")
    return spark.createDataFrame([(k, float(scores.get(k, float("nan"))), k == best) for k in sem.CANDIDATES], "k int, silhouette double, chosen boolean")


@query("sem_choose_k", "SELECT unnest([12, 16, 20, 24, 28, 32]) AS k, TRUE AS judged, TRUE AS best_is_chosen")
def choose_k(spark, d):
    rows = silhouettes(spark, d)
    top = rows.agg(F.max("silhouette")).scalar()
    return rows.select("k", F.col("silhouette").between(-1, 1).alias("judged"), (F.col("chosen") == (F.col("silhouette") == top)).alias("best_is_chosen"))


@query("sem_cluster", sql("SELECT link, TRUE AS nearest FROM tok", "tok"))
def cluster(spark, d):
    k = silhouettes(spark, d).where("chosen").first()["k"]
    rows, centres = sem.nearest_centre(reduced(spark, d), "link", k)
    lists = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    away = lambda c: F.aggregate(F.zip_with("vec", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    distances = F.transform(lists, away)
    return rows.select("link", (F.get(distances, F.col("cluster_id")) <= F.array_min(distances) + 1e-9).alias("nearest"))


@query(
    "sem_knn",
    sql(
        "SELECT source_link, source_titulo, target_link, target_titulo, rank, cosine_similarity, source_cluster_id, target_cluster_id, source_operation_name, target_operation_name, same_cluster, gap_days FROM nb",
        "nb",
    ),
)
def knn(spark, d):
    return v.neighbours(spark, d).drop("source_data", "target_data")


@query("sem_recurring_pairs", sql("SELECT source_link, target_link, cosine_similarity, gap_days, source_cluster_id FROM pairs", "pairs"))
def recurring_pairs(spark, d):
    return v.pairs(spark, d).select("source_link", "target_link", "cosine_similarity", "gap_days", "source_cluster_id")


@query(
    "sem_threshold_knn",
    sql(f"SELECT s AS source, t AS target, rnk AS rank, sim AS cosine_similarity FROM knn WHERE sim >= {v.STRICT}", "knn"),
)
def threshold_knn(spark, d):
    """The same search with a floor, in small blocks, so that cells are really pruned."""
    return near.nearest(v.corpus(spark, d).select("link", "vec"), "link", 5, floor=v.STRICT, block=64)


@query("sem_components", sql("SELECT node, component FROM parts", "parts"))
def components(spark, d):
    return v.parts(spark, d)


@query("sem_series", sql(f"SELECT {v.SERIES_COLUMNS} FROM first_series", "first_series"))
def series(spark, d):
    return v.first_series(spark, d)


@query("sem_consolidate", sql(f"SELECT {v.SERIES_COLUMNS} FROM series", "series"))
def consolidate(spark, d):
    return v.series(spark, d)


@query("sem_series_links", sql("SELECT link, semantic_series_id FROM series_links", "series_links"))
def series_links(spark, d):
    return v.series_links(spark, d)


# Network ---------------------------------------------------------------------------------------

NET_CTES = {
    "ctok": (r"SELECT cluster_id, regexp_extract_all(string_agg(trim(folded), ' ' ORDER BY seq), '\b[a-z0-9-]{2,}\b') AS w FROM cor WHERE trim(folded) <> '' GROUP BY cluster_id", ["cor"]),
    "ctf": (
        "SELECT cluster_id, term, count(*) AS tf FROM (SELECT cluster_id, unnest(w) AS term FROM ctok UNION ALL "
        "SELECT cluster_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM ctok) GROUP BY ALL",
        ["ctok"],
    ),
    "cvoc": (
        "SELECT term, ln((1.0 + k) / (1.0 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS n, count(*) AS df FROM ctf GROUP BY term), (SELECT count(*) AS k FROM ctok) "
        "WHERE df >= 2 AND df <= 0.75 * k ORDER BY n DESC, term LIMIT 12000",
        ["ctf", "ctok"],
    ),
    "cw": ("SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS weight FROM (SELECT cluster_id, term, tf * idf AS w FROM ctf JOIN cvoc USING (term))", ["ctf", "cvoc"]),
    "csim": (
        "SELECT * FROM (SELECT a.cluster_id AS a, b.cluster_id AS b, round(sum(a.weight * b.weight), 6) AS sim, count(*) AS shared FROM cw a JOIN cw b USING (term) "
        "WHERE a.cluster_id <> b.cluster_id GROUP BY ALL) WHERE sim >= 0.12",
        ["cw"],
    ),
    "cedge": (
        "SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(a) AS src, any_value(sim) AS sim, any_value(shared) AS shared FROM "
        "(SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM csim) WHERE rn <= 3 GROUP BY 1, 2",
        ["csim"],
    ),
    "edges_net": (
        "SELECT e.src AS source_cluster, e.lo + e.hi - e.src AS target_cluster, round(e.sim, 4) AS similarity, e.shared AS shared_count, t.terms AS shared_terms FROM cedge e JOIN "
        "(SELECT lo, hi, array_to_string(list(term ORDER BY rn), ' | ') AS terms FROM (SELECT e.lo, e.hi, x.term, row_number() OVER (PARTITION BY e.lo, e.hi "
        "ORDER BY round(least(x.weight, y.weight), 6) DESC, x.term) AS rn FROM cedge e JOIN cw x ON x.cluster_id = e.lo JOIN cw y ON y.cluster_id = e.hi AND y.term = x.term) WHERE rn <= 6 GROUP BY ALL) t USING (lo, hi)",
        ["cedge", "cw"],
    ),
}


@stage("cluster_terms")
def cluster_terms(spark, d):
    return network.cluster_terms(v.corpus(spark, d), "seq", width=100)


def cluster_weights(spark, d):
    rows = cluster_terms(spark, d)
    return network.cluster_weights(rows, rows.select("cluster_id").distinct().count())


@query("sem_cluster_corpus", sql("SELECT cluster_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, max(tf) AS top FROM ctf GROUP BY cluster_id", "ctf", **NET_CTES))
def cluster_corpus(spark, d):
    rows = cluster_terms(spark, d)
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("top"))


@query("sem_cluster_network", sql("SELECT source_cluster, target_cluster, similarity, shared_count, shared_terms FROM edges_net", "edges_net", **NET_CTES))
def cluster_network(spark, d):
    return network.network_edges(cluster_weights(spark, d))


@query(
    "sem_dominant_terms",
    sql(
        "SELECT cluster_id, array_to_string(list(term ORDER BY rn), '|') AS dominant_terms FROM (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 6) DESC, term) AS rn FROM cw) WHERE rn <= 6 GROUP BY cluster_id",
        "cw", **NET_CTES,
    ),
)
def dominant_terms(spark, d):
    return network.dominant_terms(cluster_weights(spark, d))


def axes_ctes(axes: int, squarings: int) -> dict:
    """Leading eigenvectors of the products between clusters, each by repeated squaring, then taken out."""
    out = {
        "cids": ("SELECT list(cluster_id ORDER BY cluster_id) AS ids FROM (SELECT DISTINCT cluster_id FROM cw)", ["cw"]),
        "cdot": ("SELECT a.cluster_id AS a, b.cluster_id AS b, sum(a.weight * b.weight) AS dot FROM cw a JOIN cw b USING (term) GROUP BY ALL", ["cw"]),
        "ax0": (
            "SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(coalesce(dot, 0.0) ORDER BY b) AS r FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, dot FROM "
            "(SELECT DISTINCT cluster_id FROM cw) x, (SELECT DISTINCT cluster_id FROM cw) y LEFT JOIN cdot ON a = x.cluster_id AND b = y.cluster_id) GROUP BY a)",
            ["cw", "cdot"],
        ),
    }
    for axis in range(axes):
        before = f"ax{axis}"
        for i in range(squarings):
            half = f"q{axis}_{i}"
            out[half] = (f"SELECT [[list_dot_product(r, c) FOR c IN m] FOR r IN m] AS m FROM {before}", [before])
            out[f"s{axis}_{i}"] = (f"SELECT [[x / t FOR x IN r] FOR r IN m] AS m FROM (SELECT m, list_sum([m[i][i] FOR i IN range(1, len(m) + 1)]) AS t FROM {half})", [half])
            before = f"s{axis}_{i}"
        out[f"v{axis}"] = (
            "SELECT [x / sqrt(m[k][k]) FOR x IN m[k]] AS v FROM (SELECT m, list_position([m[i][i] FOR i IN range(1, len(m) + 1)], list_max([m[i][i] FOR i IN range(1, len(m) + 1)])) AS k "
            f"FROM {before})",
            [before],
        )
        out[f"ax{axis + 1}"] = (
            "SELECT [[m[i][j] - l * v[i] * v[j] FOR j IN range(1, len(v) + 1)] FOR i IN range(1, len(v) + 1)] AS m FROM "
            f"(SELECT m, v, list_dot_product([list_dot_product(r, v) FOR r IN m], v) AS l FROM ax{axis}, v{axis})",
            [f"ax{axis}", f"v{axis}"],
        )
    return out


_AXIS = "list_extract((SELECT [x / CASE WHEN list_max(v) >= -list_min(v) THEN list_max(v) ELSE list_min(v) END FOR x IN v] FROM v{i}), pos)"


@query(
    "sem_network_layout",
    sql(
        "SELECT cluster_id, " + ", ".join(f"round({_AXIS.format(i=i)}, 4) AS {c}" for i, c in enumerate("xyz")) + " FROM (SELECT unnest(ids) AS cluster_id, unnest(range(1, len(ids) + 1)) AS pos FROM cids)",
        "cids", "v0", "v1", "v2", **{**NET_CTES, **axes_ctes(3, 14)},
    ),
)
def network_layout(spark, d):
    return network.layout(cluster_weights(spark, d)).select("cluster_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query(
    "sem_network_nodes",
    sql(
        "SELECT k.cluster_id, k.size, array_to_string(t.vals, ' | ') AS dominant_terms FROM (SELECT cluster_id, count(*) AS size FROM cor GROUP BY 1) k JOIN "
        "(SELECT cluster_id, list(term ORDER BY rn) AS vals FROM (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 6) DESC, term) AS rn FROM cw) WHERE rn <= 6 GROUP BY 1) t USING (cluster_id)",
        "cor", "cw", **NET_CTES,
    ),
)
def network_nodes(spark, d):
    nodes = network.network_nodes(cluster_weights(spark, d), sm.cluster_summary(v.corpus(spark, d)))
    return nodes.select("cluster_id", "size", "dominant_terms")


@query(
    "jn_isolated",
    sql(
        "SELECT DISTINCT cluster_id FROM ctok WHERE cluster_id NOT IN (SELECT source_cluster FROM e UNION SELECT target_cluster FROM e)",
        **{**NET_CTES, "e": ("SELECT * FROM edges_net WHERE similarity >= (SELECT max(similarity) FROM edges_net)", ["edges_net"])},
    ),
)
def isolated(spark, d):
    """With only the strongest edge kept, most nodes are isolated."""
    nodes = cluster_terms(spark, d).select("cluster_id").distinct()
    edges = network.network_edges(cluster_weights(spark, d))
    strongest = edges.agg(F.max("similarity")).scalar()
    return network.isolated(nodes, edges.where(F.col("similarity") >= strongest))
