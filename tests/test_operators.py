"""Operators against brute force, on skewed and on empty inputs."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsatlas import session
from newsatlas.functions import lexicon
from newsatlas.operators import browse, corpus as ops, graph, keys, neighbours as near, network, search, semantic, summaries as sm


def brute_knn(vectors, k, floor=None):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm == 0, 1, norm)
    sims = np.round(m @ m.T, 6) + 0.0
    out = set()
    for a, i in enumerate(ids):
        ranked = sorted((-sims[a, b], j) for b, j in enumerate(ids) if b != a and (floor is None or sims[a, b] >= floor))
        out |= {(i, j, r, -s) for r, (s, j) in enumerate(ranked[:k], start=1)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = {f"n{i:03d}": (centres[i % 6] + rng.normal(scale=0.2, size=8)).round(3).tolist() for i in range(200)}
    rows |= {f"c{i:03d}": rows["n001"] for i in range(100)}  # a third of the rows are copies of one vector
    rows["zero"] = [0.0] * 8
    return rows


@pytest.mark.parametrize("block,floor", [(2048, None), (24, None), (24, 0.9)])
def test_nearest_is_exact(spark, vectors, block, floor):
    df = spark.createDataFrame(list(vectors.items()), "link string, vec array<double>")
    got = {tuple(r) for r in near.nearest(df, "link", 5, floor, block).select("source", "target", "rank", "cosine_similarity").collect()}
    assert {g[:3] for g in got} == {b[:3] for b in brute_knn(vectors, 5, floor)}


def test_blocks_are_rings_of_bounded_size(spark, vectors, monkeypatch):
    df = spark.createDataFrame(list(vectors.items()), "link string, vec array<double>").select("link", near.unit("vec").alias("vec"))
    _, entries = near._distinct(df, "link")
    placed, _, count = near._cells(entries, "string", entries.count(), 24)
    rows = placed.collect()
    assert {r["block"] for r in rows} <= set(range(count)) and len(rows) == 201
    assert max(collections.Counter(r["block"] for r in rows).values()) <= 48
    kept = []
    monkeypatch.setattr(near, "block_pairs", lambda a, b, own=near.block_pairs: kept.append(own(a, b)) or kept[-1])
    floor = near.nearest(df, "link", 5, 0.9, 24).count()
    pairs = [tuple(r) for r in kept[0].collect()]
    assert floor and len(pairs) == len(set(pairs)) < count * (count - 1) / 2  # clusters far apart don't meet


def test_a_pair_found_twice_is_one_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = {f"r{i:02d}": rng.normal(size=3).tolist() for i in range(90)}
    df = spark.createDataFrame(list(rows.items()), "link string, vec array<double>")
    monkeypatch.setattr(near, "TILE", 1)
    got = {tuple(r)[:3] for r in near.nearest(df, "link", 7, None, 9).select("source", "target", "rank").collect()}
    assert got == {b[:3] for b in brute_knn(rows, 7)}


@pytest.mark.parametrize("tile", [3, 100])
def test_tiles_hand_on_only_the_best(spark, monkeypatch, tile):
    """A row leaves a pair of tiles with at most k targets, however many blocks these hold."""
    rng = np.random.default_rng(2)
    rows = {f"r{i:03d}": rng.normal(size=4).tolist() for i in range(150)}
    df = spark.createDataFrame(list(rows.items()), "link string, vec array<double>")
    monkeypatch.setattr(near, "BLOCK", 9)
    monkeypatch.setattr(near, "TILE", tile)
    met = []
    monkeypatch.setattr(near, "top_per_key", lambda rows, by, *rest, own=keys.top_per_key: met.append((by, rows)) or own(rows, by, *rest))
    got = {tuple(r)[:3] for r in near.nearest(df, "link", 5, None, 9).select("source", "target", "rank").collect()}
    assert got == {b[:3] for b in brute_knn(rows, 5)}
    found = next(rows for by, rows in met if by == ["source"])
    assert found.count() == found.distinct().count()
    assert tile == 3 or found.groupBy("source").count().agg(F.max("count")).first()[0] <= 5


def test_rows_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    """Tiles grow with the number of blocks, so that a row isn't sent once for each small tile."""
    rng = np.random.default_rng(4)
    rows = {f"r{i:03d}": rng.normal(size=4).tolist() for i in range(150)}
    df = spark.createDataFrame(list(rows.items()), "link string, vec array<double>")
    for name, x in {"BLOCK": 4, "TILE": 1, "TILES": 10}.items():
        monkeypatch.setattr(near, name, x, raising=False)
    sent = []
    monkeypatch.setattr(near, "by_key", lambda rows, *by, own=near.by_key: sent.append(rows) or own(rows, *by))
    got = {tuple(r)[:3] for r in near.nearest(df, "link", 5, None, 4).select("source", "target", "rank").collect()}
    assert got == {b[:3] for b in brute_knn(rows, 5)}
    assert sum(x.count() for x in sent) <= 150 * 15


def test_a_length_is_computed_once_for_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "vec array<float>").select(near.unit("vec").alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, [1.0, None]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_vectors_of_two_lengths_are_refused():
    with pytest.raises(ValueError, match="length"):
        near._matrix(pa.array([[1.0, 2.0, 3.0], [1.0]]))
    assert near._matrix(pa.chunked_array([[[1.0, 2.0]], [[3.0, 4.0]]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_marks_are_found_at_any_width():
    for shape in [(1, 1), (3, 5), (4, 8), (7, 9), (2, 0)]:
        m = np.random.default_rng(6).random(shape, dtype=np.float32)
        bound = np.full(shape[1], 0.7, np.float32)
        assert [x.tolist() for x in near._hits(m, bound)] == [x.tolist() for x in np.nonzero(m >= bound)]


def test_meeting_in_small_steps(monkeypatch):
    """Two tiles with ties and without any bound, in chunks of few rows, against brute force."""
    monkeypatch.setattr(near, "CHUNK", 7)
    monkeypatch.setattr(near, "HITS", 16)
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, size=(60, 3)).astype(float)
    pivots = near._units(list(rng.normal(size=(4, 3))))
    units = near._units(list(m))
    angles = near._angles(units, pivots)
    cell = angles.argmin(axis=1)

    def side(ids):
        rows = {"rep": ids, "need": np.full(len(ids), -1.0), "block": cell[ids] + 4 * (ids[0] > 0), "cell": cell[ids], "angle": angles[ids, cell[ids]], "vec": list(m[ids])}
        return near._Side(pa.table(rows), 4, pivots)

    left, right = side(np.arange(40)), side(np.arange(40, 60))
    near._meet(left, right)
    near._meet(left, None)
    sims = np.round(units @ units.T, 6) + 0.0
    expect = {i: sorted((-sims[i, j], j) for j in range(60) if j != i and (i < 40 or j < 40))[:4] for i in range(60)}
    got = collections.defaultdict(list)
    for one in (left, right):
        for i, j, x in zip(*one.found()):
            got[i].append((-x, j))
    assert {i: sorted(x) for i, x in got.items()} == expect


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components_with_hub_chain_and_order(spark):
    rng = random.Random(3)
    edges = [("hub", f"h{i:03d}") for i in range(120)] + [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(40)]
    edges += [(f"r{rng.randrange(80):02d}", f"r{rng.randrange(80):02d}") for _ in range(45)] + [("s", "s")]
    expected = union_find([e for e in edges if e[0] != e[1]])
    rng.shuffle(edges)
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "source_link string, target_link string")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == expected


def test_components_of_a_chain_whose_keys_jump(spark, monkeypatch):
    """Small keys stand far apart on the chain, so labels that move edge by edge take 32 rounds or so."""
    n = 64
    order = sorted(range(n), key=lambda i: f"{i:06b}"[::-1])  # keys along the chain, in the order of their reversed bits
    links = [(f"k{a:02d}", f"k{b:02d}") for a, b in itertools.pairwise(order)]
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or session.cut(df))
    parts = graph.components(spark.createDataFrame(links, "source_link string, target_link string"))
    assert {r["node"]: r["component"] for r in parts.collect()} == {f"k{i:02d}": "k00" for i in range(n)}
    assert len(written) <= 2 + 2 * 8, "a round writes twice"


def test_lookup_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(600)] + [(1000, None), (1001, "none")]
    table = [("hot", 1)] + [(f"k{i}", i) for i in range(50)]
    df, t = spark.createDataFrame(rows, "id int, key string"), spark.createDataFrame(table, "key string, v int")
    got = {(r["id"], r["v"]) for r in keys.lookup(df, t, "key", 0.05).collect()}
    assert got == {(i, dict(table).get(k)) for i, k in rows}
    assert [r[0] for r in keys.hot_keys(df, "key", 0.05).collect()] == ["hot"]


def test_bucketed_lag_is_lag(spark):
    rng = random.Random(1)
    rows = [(g, n, f"{g}{n}") for g in "ab" for n in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "g string, n long, v string")
    got = {(r["g"], r["n"]): r["prev"] for r in keys.bucketed_lag(df, "g", "n", "v", 37, "prev").collect()}
    for g in "ab":
        mine = sorted(r for r in rows if r[0] == g)
        assert [got[g, n] for _, n, _ in mine] == [None] + [v for *_, v in mine[:-1]]


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = keys.top_per_key(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan


def test_repeated_link_fails(spark):
    index = spark.createDataFrame([("a", 1), ("a", 2)], "link string, x int")
    with pytest.raises(Exception, match="duplicate key: a"):
        ops.join_corpus(index, spark.createDataFrame([("a", 3)], "link string, y int")).collect()
    with pytest.raises(ValueError):
        ops.join_corpus(index.where("x = 1"), spark.createDataFrame([("b", 3)], "link string, y int"), require_rows=True)


def test_consecutive_ids_over_many_partitions(spark):
    rows = [(f"k{i}", (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(7)
    got = {r["k"]: r["semantic_series_id"] for r in keys.consecutive_ids(df, "k", F.col("n"), F.col("k")).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [k for k, n in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(got.values()) == list(range(1, 301))


def test_gaps_equal_row_by_row(spark):
    rng = random.Random(5)
    stamps = [f"2024-{rng.randrange(1, 4):02d}-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00" for _ in range(60)] + [None]
    df = spark.createDataFrame([(1, s) for s in stamps], "cluster_id int, t string").select("cluster_id", F.col("t").cast("timestamp").alias("data_publicacao_dt"))
    times = sorted(np.datetime64(s) for s in stamps if s)
    gaps = [int((b - a) // np.timedelta64(1, "D")) for a, b in zip(times, times[1:])]
    assert {r["gap_days"]: r["n"] for r in sm.gap_counts(df).collect()} == dict(collections.Counter(gaps))
    stats = sm.gap_stats(df).first()
    assert stats["median_gap_days"] == round(float(np.median(gaps)), 2)
    assert stats["mean_gap_days"] == pytest.approx(round(float(np.mean(gaps)), 2))


def test_cluster_terms_cross_article_borders(spark):
    rows = [(1, 0, "aa bb"), (1, 5, ""), (1, 9, "cc"), (1, 300, "dd aa"), (2, 4, "bb cc")]
    df = spark.createDataFrame(rows, "cluster_id int, seq long, texto_busca_normalizado string")
    got = {(r["cluster_id"], r["term"]): r["tf"] for r in network.cluster_terms(df, width=10).collect()}
    assert got == {
        (1, "aa"): 2, (1, "bb"): 1, (1, "cc"): 1, (1, "dd"): 1, (1, "aa bb"): 1, (1, "bb cc"): 1, (1, "cc dd"): 1, (1, "dd aa"): 1,
        (2, "bb"): 1, (2, "cc"): 1, (2, "bb cc"): 1,
    }


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(semantic.counted("t")).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def brute_grams(text, low, high):
    out = collections.Counter()
    for w in text.split():
        w = f" {w} "
        out.update(w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1))
    return out


def test_character_grams(spark):
    texts = {"x": "a bb\tccc a", "y": "", "z": "  longword "}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = collections.defaultdict(dict)
    for r in search.word_grams(df, "k", "t", 3, 5).collect():
        got[r["k"]][r["gram"]] = r["tf"]
    for k, t in texts.items():
        assert got[k] == dict(brute_grams(t, 3, 5))


def test_term_resolution(spark):
    values = spark.createDataFrame([("Mineração",), ("Cigarros",)], "value string")
    assert search.resolve_term(values, " mineracao ") == ("Mineração", 1.0)
    name, score = search.resolve_term(values, "cigaros")
    assert name == "Cigarros" and 0.3 < score < 1
    assert search.resolve_term(values, "zzzz") == ("Cigarros", 0.0)
    assert search.resolve_term(values, "  ") == ("", 0.0)
    assert search.resolve_term(values.limit(0), "x") == ("x", 0.0)


def article(i, title, stamp="2024-01-01 10:00:00", **more):
    row = dict(link=f"l{i}", seq=i, titulo=title, subtitulo=None, tags="Bahia | tema", markdown_text="texto", publicado=stamp, cluster_id=1)
    return {**row, **more}


def make(spark, rows):
    schema = "link string, seq long, titulo string, subtitulo string, tags string, markdown_text string, publicado string, cluster_id int"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    return ops.enrich(ops.with_dates(df.withColumn("publicado", F.col("publicado").cast("timestamp")), "publicado"))


def test_empty_inputs(spark):
    df = make(spark, [])
    assert sm.labels_by_year(df, "crime_labels", "crime_label").collect() == []
    for key in ("ano", "cluster_id"):
        assert sm.states_by(df, key).collect() == []
    assert sm.crime_state_year(df).collect() == []
    assert sm.states_from_corpus(df).collect() == []
    assert sm.dual_map(df, df).collect() == []
    assert sm.cluster_summary(df).collect() == []
    assert sm.temporal_recurrence(df).collect() == []
    assert search.fuzzy_text(df, "nada").rows.collect() == []
    assert search.match_signal(df.withColumn("tags_list", F.array()), search.TAG, "x").rows.collect() == []
    assert graph.components(spark.createDataFrame([], "source_link string, target_link string")).collect() == []


def test_blank_and_null_text(spark):
    rows = [article(1, None, None, tags=None, markdown_text=None), article(2, "", tags="", markdown_text="  ")]
    got = make(spark, rows).orderBy("link").collect()
    assert [r["texto_busca"] for r in got] == ["", ""]
    assert [r["ano_mes"] for r in got] == ["NaT", "2024-01"]
    assert got[0]["crime_labels"] == [] and got[0]["ufs_mencionadas"] == [] and got[0]["nome_operacao"] is None


def test_unknown_month_counts(spark):
    rows = [article(i, "t", None) for i in range(3)] + [article(9, "t")]
    got = sm.temporal_recurrence(make(spark, rows)).first()
    assert (got["noticias"], got["active_years"], got["active_months"]) == (4, 1, 2)
    assert (got["peak_year_month"], got["peak_year_month_count"]) == ("NaT", 3)
    assert (got["peak_calendar_month"], got["peak_calendar_month_share"]) == (1, 0.25)


def test_fuzzy_search_falls_back(spark):
    df = make(spark, [article(i, t) for i, t in enumerate(["contrabando de cigarros", "mineracao ilegal", "outra coisa"])])
    hit = search.fuzzy_text(df, "contrabamdo de cigaros")
    assert [r["link"] for r in hit.rows.collect()] == ["l0"]
    assert hit.resolved.endswith("(aproximado)") and 0.2 < hit.score < 1
    assert search.fuzzy_text(df, "ILEGAL").score == 1.0
    assert search.fuzzy_text(df, " ").rows.collect() == []


def test_state_filter(spark):
    df = make(spark, [article(1, "x"), article(2, "y", tags="Goias")])
    assert [r["link"] for r in ops.by_state(df, "Goias").collect()] == ["l2"]
    assert ops.by_state(df, "Todos").count() == 2 and ops.by_state(df, "Atlantis").count() == 0


def test_space_and_clusters_hold_their_invariants(spark):
    rng = random.Random(2)
    topics = [["alfa", "beta", "gama", "delta"], ["rio", "lago", "monte", "vale"], ["verde", "azul", "roxo", "preto"]]
    docs = [(f"d{i}", [rng.choice(topics[i % 3]) for _ in range(12)]) for i in range(240)]
    df = spark.createDataFrame(docs, "link string, terms array<string>")
    model = semantic.fit_tfidf(df)
    total = model.rows(df, "link").groupBy("link").agg(F.sum(F.col("weight") ** 2).alias("s")).select(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    vecs = semantic.reduced_vectors(model.vectors(df).select("link", "tfidf"), "link", max_components=5).cache()
    lengths = [(len(r["vec"]), float(np.linalg.norm(r["vec"]))) for r in vecs.collect()]
    assert {n for n, _ in lengths} == {5} and all(x == pytest.approx(1) for _, x in lengths)
    best, scores = semantic.choose_k(vecs, "link", candidates=(2, 3, 6), n_init=2)
    assert best in scores and scores[best] == max(scores.values()) and best == 3
    labels = semantic.assign_clusters(vecs, "link", 3, n_init=3).select("link", "cluster_id").collect()
    assert len({(int(r["link"][1:]) % 3, r["cluster_id"]) for r in labels}) == 3 and len(labels) == 240


def test_text_is_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    """One row group, which splits of any size leave to one task."""
    rows = spark.range(400).select("id", F.repeat(F.lit("palavra "), F.lit(50)).alias("text")).coalesce(1)
    rows.write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "TASK_BYTES", 8000)
    dealt = session.spread_text(spark.read.parquet(str(tmp_path / "t")), "text")
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert sum(sizes) == 400 * 400 and max(sizes) <= 2 * 8000


def test_index_moves_no_cell_before_it_is_stored(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "um texto"), ("b", "outro texto"), ("c", None)], "link string, t string")
    read = lambda: sorted(map(tuple, search.gram_index(rows, "link", "t").withColumn("weight", F.round("weight", 9)).collect()))
    plan = search.gram_index(rows, "link", "t")._jdf.queryExecution().executedPlan().toString()
    near_cells = read()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(search, "BROADCAST_GRAMS", 0)
    assert near_cells and read() == near_cells


def test_weights_of_joined_vectors(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "b"] if i % 2 else ["a", "c"], i % 3) for i in range(12)], "i int, terms array<string>, g int")
    fitted = semantic.fit_tfidf(docs, min_df=1, max_df=1.0)
    joined = fitted.vectors(docs.select("i", "terms")).select("i", "tfidf").join(docs.select("i", "g"), "i")
    assert sorted(map(tuple, fitted.weights(joined, "g").collect())) == sorted(map(tuple, fitted.rows(docs, "g").collect()))


def test_decomposition_settles_in_few_passes(spark):
    """Slowly falling singular values; the leading direction is settled far beyond the tolerance."""
    rng = np.random.default_rng(4)
    u, v = (np.linalg.qr(rng.normal(size=(n, 120)))[0] for n in (200, 120))
    values = np.r_[1.5, np.linspace(1.0, 0.4, 119)]
    m = u * values @ v.T
    rows = [([], [])] + [(list(range(120)), r.tolist()) for r in m] + [([], [])]
    cells = spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(3)
    found = semantic.decompose(cells, 120, 10)
    assert found.rounds <= 10 and found.residuals.max() <= semantic.TOLERANCE
    assert abs(found.values[0] - 1.5) < 1e-9 and abs(abs(found.basis[:, 0] @ v[:, 0]) - 1.0) < 1e-9
    assert np.allclose(found.values, values[:10], atol=0.004)


def test_sort_modes_put_unknown_dates_last(spark):
    rows = [(1, 5, 2, "2020-01-01"), (2, 5, 2, None), (3, 9, 1, "2021-01-01")]
    df = spark.createDataFrame(rows, "semantic_series_id long, size int, active_years int, d string")
    df = df.withColumns({c: F.col("d").cast("timestamp") for c in ("first_date", "last_date")}).withColumns(
        {"operation_names": F.lit(""), "series_group_key": F.lit("crime::x")}
    )
    catalog = browse.series_catalog(df)
    order = lambda mode: [r["semantic_series_id"] for r in browse.sort_catalog(catalog, mode).collect()]
    assert order(browse.STRENGTH) == [1, 2, 3] and order(browse.SIZE) == [3, 1, 2] and order(browse.LATEST) == [3, 1, 2]


def test_lexicon_table_lists_every_keyword(spark):
    assert lexicon.lexicon_table(spark).count() == sum(len(k) for rules in (lexicon.CRIMES, lexicon.MODUS) for k in rules.values())


def test_network_and_layout(spark):
    texts = {0: "aa bb cc dd", 1: "aa bb cc ee", 2: "ff gg hh", 3: "ff gg ii"}
    df = spark.createDataFrame([(c, c, t) for c, t in texts.items()], "cluster_id int, seq long, texto_busca_normalizado string")
    weights = network.cluster_weights(network.cluster_terms(df), 4).cache()
    edges = network.network_edges(weights)
    assert {(r["source_cluster"], r["target_cluster"]) for r in edges.collect()} == {(0, 1), (2, 3)}
    places = {r["cluster_id"]: np.array([r["x"], r["y"], r["z"]]) for r in network.layout(weights).collect()}
    assert np.abs(np.stack(list(places.values()))).max(axis=0)[:2] == pytest.approx([1, 1])
    assert np.linalg.norm(places[0] - places[1]) < np.linalg.norm(places[0] - places[2])
    nodes = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(5)], "cluster_id int, x double, y double, z double")
    assert [r["cluster_id"] for r in network.isolated(nodes, edges).collect()] == [4]
    assert network.place_edges(edges, nodes).count() == 2


@pytest.fixture(scope="module")
def spelled_rows(spark):
    rng = random.Random(5)
    words = ["operacao", "estrela", "guia", "fronteira", "carga", "bens", "porto", "aduana", "selva", "rio"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(3, 30))) + (" zumbi" if i % 50 == 0 else "") for i in range(300)]
    return spark.createDataFrame([(f"l{i:03d}", t) for i, t in enumerate(texts)] + [("empty", ""), ("none", None)], "link string, texto_busca_normalizado string")


@pytest.mark.parametrize("ranges", [1, 16])
def test_stored_index_scores_like_a_full_scan(spark, spelled_rows, tmp_path, ranges):
    from newsatlas.operators.gram_store import GramStore, spelled

    rows = search.gram_index(spelled_rows, "link", "texto_busca_normalizado").cache()
    store = GramStore.write(rows, str(tmp_path / "index"), "link", ranges)
    assert len(store.borders) <= ranges and store.rows().count() == rows.count()
    for text in ("estrella guiia", "zumbis", "fronteyra do rrio", "xyzxyz", "a"):
        full = {r["link"]: r["score"] for r in search.score_index(rows, "link", search.query_grams(spelled_rows, text, search.TEXT_GRAMS)).collect() if r["score"] > 0}
        for floor in (0.0, 0.1, 0.2, 0.45):
            got = {r["link"]: r["score"] for r in store.scores(spelled(text, *search.TEXT_GRAMS), floor).collect()}
            assert set(got) == {k for k, s in full.items() if s >= floor}
            assert all(abs(got[k] - full[k]) <= 1e-6 for k in got)


def test_stored_index_reads_only_the_ranges_of_the_query(spark, spelled_rows, tmp_path):
    from newsatlas.operators.gram_store import GramStore

    GramStore.write(search.gram_index(spelled_rows, "link", "texto_busca_normalizado"), str(tmp_path / "index"), "link", 16)
    store = GramStore.open(spark, str(tmp_path / "index"))
    hits = store.read("postings", [" zu", "zumbi"])
    opened = {f.split("part=")[1].split("/")[0] for f in hits.inputFiles()}
    assert 1 <= len(opened) <= 4 < len(store.borders) and {r["link"] for r in hits.collect()} == {f"l{i:03d}" for i in range(0, 300, 50)}
    assert "EqualTo(gram, zu)" in hits._jdf.queryExecution().toString().replace("gram,  zu", "gram, zu")
    assert store.read("postings", ["\x01"]) is None


def test_light_grams_are_left_to_those_a_heavy_one_brings_up():
    from newsatlas.operators.gram_store import GramStore, Term

    terms = [Term("a", 0.1, 0.02, 900), Term("b", 0.1, 0.05, 500), Term("c", 0.9, 0.6, 3)]
    light, heavy, rest = GramStore.split(None, terms, 0.2)
    assert [t.gram for t in light] == ["a", "b"] and [t.gram for t in heavy] == ["c"] and abs(rest - 0.07) < 1e-9
    assert GramStore.split(None, terms, 0.0)[1] == terms


def test_fuzzy_search_falls_back_to_lower_floors(spark, spelled_rows):
    store = search.store_index(spelled_rows, "link", "texto_busca_normalizado")
    few = spelled_rows.where("link < 'l010'")
    for rows in (spelled_rows, few):
        scores = search.score_index(store.rows(), "link", search.query_grams(rows, "zumbie", search.TEXT_GRAMS)).join(rows.select("link"), "link", "left_semi").collect()
        strong = {r["link"] for r in scores if r["score"] >= 0.2}
        ranked = sorted(scores, key=lambda r: (-r["score"], r["link"]))[:150]
        expected = strong if len(strong) >= 12 else {r["link"] for r in ranked if r["score"] >= 0.1}
        found = search.fuzzy_text(rows, "zumbie", index=store)
        assert {r["link"] for r in found.rows.collect()} == expected
        assert abs(found.score - max(r["score"] for r in scores)) < 1e-6
    nothing = search.fuzzy_text(few, "qqqq", index=store)
    assert nothing.rows.count() == 0 and nothing.score == 0.0
