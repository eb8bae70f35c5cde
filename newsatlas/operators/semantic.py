"""Token counts, TF-IDF, reduced vectors and clusters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from inspect import signature
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.gazetteer import is_geographic_term, without_geography
from newsatlas.functions.lexicon import STOP_WORDS
from newsatlas.operators.keys import ranked_list, top_per_key
from newsatlas.operators.kmeans import Fit, added_up, blocks, cosine_silhouettes, fit_all, matrix, nearest
from newsatlas.operators.term_counts import frequent_hashes, term_stats
from newsatlas.session import cut

TOKEN = r"\b[a-z0-9-]{2,}\b"
CANDIDATES = (12, 16, 20, 24, 28, 32)
OVERSAMPLE, TOLERANCE, MOST_ROUNDS = 24, 0.002, 40  # of the block Krylov iteration
LEADING = 1e-9  # residual of the first pair, whose direction is a result of its own
KEPT = 3  # widths of the iteration's basis that the driver holds at most
TERM_BLOCK = 512  # terms in a block of its sums
CELLS, SLICE = 1 << 14, 64  # nonzero cells and rows multiplied at once


def words(text: Column | str) -> Column:
    """Tokens of a text after the geography-free preprocessing, stop words removed."""
    found = F.regexp_extract_all(without_geography(text), F.lit(TOKEN), 0)
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def with_bigrams(tokens: Column | str) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    arr = as_col(tokens)
    pairs = F.zip_with(
        F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))),
        F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(arr, pairs)


def word_lists(df: DataFrame, text: str = "texto_ponderado", out: str = "words") -> DataFrame:
    return df.withColumn(out, words(text))


def tokens(df: DataFrame, text: str = "texto_ponderado", out: str = "terms") -> DataFrame:
    return word_lists(df, text, "__words").withColumn(out, with_bigrams("__words")).drop("__words")


def counted(terms: Column | str) -> Column:
    """Array of struct(term, tf), inside the row: sorted terms cut where the value changes."""
    arr = F.array_sort(as_col(terms))

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        cells = lambda st: F.transform(
            st, lambda i, j: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(st, j + 1), n + 1) - i).alias("tf"))
        )
        return F.when(n > 0, F.flatten(F.transform(F.array(starts), cells)))

    return F.flatten(F.transform(F.array(arr), lambda s: F.coalesce(runs(s), F.array().cast("array<struct<term:string,tf:int>>"))))


def vocabulary(
    stats: DataFrame, n_docs: int, min_df: int = 3, max_df: float = 0.80, max_features: int | None = 40_000
) -> DataFrame:
    """The most frequent terms within the document-frequency limits, with their idf.

    At most ``max_features`` rows, which is what allows it to be broadcast or brought to the driver; rarer terms are
    left out. None keeps every term within the document-frequency limits.
    """
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    ranked = kept.orderBy(F.desc("tf"), "term")
    return (ranked if max_features is None else ranked.limit(max_features)).withColumn("idf", idf)


class Tfidf:
    """A fitted vocabulary: sparse unit vectors in the JVM, and the same weights as rows."""

    def __init__(self, vocab: DataFrame, terms: str = "terms"):
        idf = {r["term"]: r["idf"] for r in vocab.select("term", "idf").collect()}  # at most max_features terms
        if not idf:
            raise ValueError("the vocabulary is empty")
        listed = vocab.sparkSession.createDataFrame([([t],) for t in idf], f"{terms} array<string>")
        self.count = CountVectorizer(inputCol=terms, outputCol="__tf", minDF=1, vocabSize=len(idf)).fit(listed)
        self.terms = self.count.vocabulary
        scale = Vectors.dense([idf[t] for t in self.terms])
        self.weigh = ElementwiseProduct(scalingVec=scale, inputCol="__tf", outputCol="__w")

    def vectors(self, docs: DataFrame, out: str = "tfidf") -> DataFrame:
        """One unit-length sparse vector per row; no shuffle."""
        unit = Normalizer(p=2.0, inputCol="__w", outputCol=out)
        return unit.transform(self.weigh.transform(self.count.transform(docs))).drop("__tf", "__w")

    def rows(self, docs: DataFrame, *keys: str) -> DataFrame:
        """(keys, term, weight), one row per document and term of the vocabulary."""
        return self.weights(self.vectors(docs.select(*keys, self.count.getInputCol())), *keys)

    def weights(self, vectors: DataFrame, *keys: str) -> DataFrame:
        """The same from ``vectors``, which are far smaller than the terms and may be joined first."""
        vec = F.unwrap_udt("tfidf")
        cells = vectors.select(*keys, F.inline(F.arrays_zip(vec["indices"].alias("idx"), vec["values"].alias("weight"))))
        names = vectors.sparkSession.createDataFrame(list(enumerate(self.terms)), "idx int, term string")
        return cells.join(F.broadcast(names), "idx").select(*keys, "term", "weight")


def fit_tfidf(docs: DataFrame, n_docs: int | None = None, **limits) -> Tfidf:
    n = docs.count() if n_docs is None else n_docs
    bounds = {name: p.default for name, p in signature(vocabulary).parameters.items() if p.default is not p.empty} | limits
    only = None if bounds["max_features"] is None else frequent_hashes(docs, "terms", n, **bounds)
    return Tfidf(vocabulary(term_stats(docs, only=only), n, **limits))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of bounded size with the concatenated indices and values of their rows, and each value's row."""
    for batch in batches:
        idx, val = batch.column("idx"), batch.column("val")
        sizes = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False).astype(int)
        idx, val = idx.flatten().to_numpy().astype(int), val.flatten().to_numpy()
        stops = np.cumsum(sizes)
        cuts = np.flatnonzero(np.diff(stops // CELLS, prepend=0)) if len(stops) else []
        for a, b in pairwise(sorted({*range(0, len(sizes), SLICE), *cuts, len(sizes)})):
            cells = slice(stops[a] - sizes[a], stops[b - 1])
            yield batch.slice(a, b - a), idx[cells], val[cells], np.repeat(np.arange(b - a), sizes[a:b])


def _filled(idx: np.ndarray, val: np.ndarray, row: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that sparse rows have cells in, and the rows over these columns alone: a small dense matrix."""
    used, place = np.unique(idx, return_inverse=True)
    out = np.zeros((count, len(used)))
    np.add.at(out, (row, place), val)
    return used, out


def _times(idx: np.ndarray, val: np.ndarray, row: np.ndarray, count: int, dense: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    used, rows = _filled(idx, val, row, count)
    return rows @ dense[used]


def _gram_product(cells: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(transposed rows) x rows x basis: a dense sum per task, added up by blocks of terms."""
    shared = cells.sparkSession.sparkContext.broadcast(basis)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        q = shared.value
        total = np.zeros_like(q)
        for part, idx, val, row in _slices(batches):
            used, rows = _filled(idx, val, row, part.num_rows)
            total[used] += rows.T @ (rows @ q[used])
        for i in range(0, len(q), TERM_BLOCK):
            yield i, total[i : i + TERM_BLOCK]

    out = np.zeros_like(basis)
    for i, x in added_up(cells, partial).items():
        out[i : i + TERM_BLOCK] = x.reshape(-1, basis.shape[1])
    shared.unpersist()
    return out


@dataclass
class Decomposition:
    """Leading right singular vectors (one column each), singular values, and how far each pair is from exact.

    A residual is the length of (transposed rows) x rows x v - value^2 v, as a share of the largest value squared.
    """

    basis: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def _beside(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``more`` adds to an orthonormal basis."""
    for _ in range(2):
        more = more / np.maximum(np.linalg.norm(more, axis=0), np.finfo(float).tiny)
        more, scale = np.linalg.qr(more - basis @ (basis.T @ more))
        more = more[:, np.abs(np.diag(scale)) > 1e-10]
    return more


def decompose(cells: DataFrame, size: int, k: int, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS, seed: int = 42) -> Decomposition:
    """The k leading singular pairs of sparse rows (idx, val), by a block Krylov iteration.

    Each round is one pass over the rows for the pairs that are not settled: what they lack widens the basis, and the best
    pairs of the whole basis are taken. Rounds end when the first pair is settled to LEADING and all others to the
    tolerance. The driver holds matrices of size x KEPT * (k + OVERSAMPLE); a basis that would be wider restarts from its pairs.
    """
    width = min(size, k + OVERSAMPLE)
    fresh, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    basis = image = np.zeros((size, 0))
    limits = np.full(width, tolerance)
    limits[0] = min(tolerance, LEADING)
    for number in range(1, most + 1):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, _gram_product(cells, fresh)])
        inner = basis.T @ image
        squares, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-squares)[:width]
        squares, turn = np.maximum(squares[order], 0.0), turn[:, order]
        pairs, product = basis @ turn, image @ turn
        off = product - pairs * squares
        scale = squares[0] if len(squares) and squares[0] > 0 else 1.0
        residuals = np.linalg.norm(off, axis=0) / scale
        if (residuals <= limits)[:k].all():
            break
        lacking = off[:, residuals > limits]
        if basis.shape[1] + lacking.shape[1] > KEPT * width:
            basis, image = pairs, product
        fresh = _beside(basis, lacking)
        if not fresh.shape[1]:
            break
    return Decomposition(pairs[:, :k], np.sqrt(squares[:k]), residuals[:k], number)


def decompose_vectors(vectors: DataFrame, column: str = "tfidf", max_components: int = 160, **settings) -> Decomposition:
    """The decomposition of a column of sparse vectors; its size is fixed by the vocabulary and component limits."""
    size = vectors.select(F.unwrap_udt(column)["size"].alias("n")).first()["n"]
    k = max(1, min(max_components, max(2, size - 1), size))
    sparse = F.unwrap_udt(column)
    return decompose(vectors.select(sparse["indices"].alias("idx"), sparse["values"].alias("val")), size, k, **settings)


def project(vectors: DataFrame, key: str, found: Decomposition, column: str = "tfidf", unit: bool = True) -> DataFrame:
    """(key, vec): the rows on the leading directions, of unit length unless told otherwise."""
    sparse = F.unwrap_udt(column)
    cells = vectors.select(key, sparse["indices"].alias("idx"), sparse["values"].alias("val"))
    basis = vectors.sparkSession.sparkContext.broadcast(found.basis)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, idx, val, row in _slices(batches):
            dense = _times(idx, val, row, rows.num_rows, basis.value)
            norm = np.linalg.norm(dense, axis=1, keepdims=True) if unit else np.ones((len(dense), 1))
            dense = dense / np.where(norm == 0, 1.0, norm)
            bounds = pa.array(np.arange(len(dense) + 1) * dense.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.ListArray.from_arrays(bounds, pa.array(dense.ravel()))], names=[key, "vec"])

    return cells.mapInArrow(run, f"`{key}` {kind}, vec array<double>")


def reduced_vectors(vectors: DataFrame, key: str, column: str = "tfidf", max_components: int = 160) -> DataFrame:
    """(key, vec): projection on the leading right singular vectors, rows of unit length.

    The decomposition is distributed; only the terms x components matrix reaches the driver.
    """
    vectors = cut(vectors.select(key, column))
    return project(vectors, key, decompose_vectors(vectors, column, max_components), column)


def silhouette(rows: DataFrame, vec: str = "vec", cluster: str = "cluster_id") -> float:
    """Mean cosine silhouette of a given grouping."""
    judge = ClusteringEvaluator(distanceMeasure="cosine", predictionCol="cluster_id", featuresCol="features")
    return judge.evaluate(rows.select(array_to_vector(vec).alias("features"), F.col(cluster).cast("int").alias("cluster_id")))


def sample_rows(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A repeatable sample of at most n rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def _best_fits(rows: DataFrame, counts: list[int], seed: int, n_init: int) -> list[Fit]:
    """The cheapest of ``n_init`` seeded fits for each count; all of them share their passes over the rows."""
    fits = fit_all(rows, [(k, seed + i) for k in counts for i in range(n_init)])
    return [min((f for f in fits if f.k == k), key=lambda f: f.cost) for k in counts]


def choose_k(
    vecs: DataFrame, key: str, seed: int = 42, candidates: tuple[int, ...] = CANDIDATES, n_init: int = 10, sample: int | None = None
) -> tuple[int, dict[int, float]]:
    """Best cluster count by cosine silhouette, and the score of every candidate that leaves a cluster to compare.

    All rows are clustered and judged; with ``sample``, only that many.
    """
    rows = blocks(vecs if sample is None else sample_rows(vecs, key, seed, sample)).cache()
    try:
        many = rows.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
        able = [k for k in candidates if k < many]
        scores = dict(zip(able, cosine_silhouettes(rows, [f.centres for f in _best_fits(rows, able, seed, n_init)]), strict=True)) if able else {}
    finally:
        rows.unpersist()
    sound = [k for k in scores if not math.isnan(scores[k])]
    return max(sound, key=lambda k: (scores[k], -k), default=candidates[0]), scores


def nearest_centre(vecs: DataFrame, key: str, k: int, seed: int = 42, n_init: int = 20) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, vec, cluster_id) from the best of ``n_init`` seeded runs over all rows, and the centres."""
    rows = blocks(vecs).cache()
    try:
        centres = _best_fits(rows, [k], seed, n_init)[0].centres
    finally:
        rows.unpersist()
    kind = vecs.schema[key].dataType.simpleString()

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(matrix(batch.column("vec")), centres) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("vec"), pa.array(own, pa.int32())], names=[key, "vec", "cluster_id"])

    return vecs.select(key, "vec").mapInArrow(label, f"`{key}` {kind}, vec array<double>, cluster_id int"), list(centres)


def assign_clusters(vecs: DataFrame, key: str, k: int, seed: int = 42, n_init: int = 20) -> DataFrame:
    """(key, vec, cluster_id) from the best of ``n_init`` seeded runs over all rows."""
    return nearest_centre(vecs, key, k, seed, n_init)[0]


def top_terms(weights: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """(cluster_id, top_terms): best mean weights per cluster, place names left out.

    ``weights`` is (cluster_id, term, weight); ``sizes`` is (cluster_id, size), one row per cluster.
    """
    sums = weights.groupBy("cluster_id", "term").agg(F.sum("weight").alias("total"))
    named = sums.where(~is_geographic_term("term")).join(F.broadcast(sizes), "cluster_id")
    mean = named.select("cluster_id", "term", F.round(F.col("total") / F.col("size"), 6).alias("mean"))
    best = top_per_key(mean, ["cluster_id"], [F.desc("mean"), F.asc("term")], k)
    return best.groupBy("cluster_id").agg(ranked_list("term").alias("top_terms"))
