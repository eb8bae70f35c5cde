"""Language by nearest centroid.

A text is a normalised TF-IDF vector over hashed character n-grams (1 to 3 letters, words padded with blanks). Each
language has several centroids, found by spherical k-means, and a text gets the language of the centroid with the
largest cosine. A text farther from that centroid than nearly all texts it was learned from is marked ``rejected``.

Learning: document frequencies are counted over all training rows, in the executors, as sums of ``DIMS`` counters per
task. The centroids are fitted on at most ``SAMPLE`` distinct texts of each language. The model is
languages x ``CLUSTERS`` x ``DIMS`` numbers, whatever the size of the corpus, and travels with the task.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be
learned; equal cosines go to the first language by code point; rows with a null language teach nothing; repeated rows
are predicted alike; an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from newsatlas.llm.frames import arrow_map, query, remainder, table, without
from newsatlas.llm.words import mixed, pieces

BITS = 13
DIMS = 1 << BITS
ORDERS = (1, 2, 3)
SAMPLE = 1500  # distinct training texts per language that the centroids are fitted on, at most
CLUSTERS = 4
ROUNDS = 12
FARTHEST = 0.005  # share of a cluster's own texts that lie beyond its radius
ROWS, BYTES = 256, 1 << 20
UNKNOWN = "und"
BLANK = 32


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters (Unicode categories L*)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (rows x DIMS), and which texts have a letter."""
    padded = [f" {(t or '').lower()} " for t in texts]
    owner = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[:-1] |= letter[1:] & (owner[1:] != np.r_[-1, owner[:-1]][:-1])  # the pad before a text that begins with a letter
    chars = np.where(letter, codes, BLANK).astype(np.uint64)[kept]
    owner, letter = owner[kept], letter[kept]
    total = np.zeros(len(texts) * DIMS, np.int64)
    for n in ORDERS:
        count = len(chars) - n + 1
        if count <= 0:
            continue
        gram = np.zeros(count, np.uint64)
        for k in range(n):
            gram |= chars[k : count + k] << np.uint64(21 * k)
        same = (owner[:count] == owner[n - 1 :]) & (letter[:count] if n == 1 else True)
        bucket = (mixed(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        total += np.bincount((owner[:count] * DIMS + bucket)[same], minlength=len(total))
    return total.reshape(len(texts), DIMS), np.bincount(owner[letter], minlength=len(texts)) > 0


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = counts.astype(np.float32) * idf
    return weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray  # the least cosine that is accepted
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, known = counted(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, known & (score < self.radius[best])


def frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """In how many texts each hashed n-gram occurs, and the number of texts last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for piece in pieces(batches, text, BYTES, ROWS):
            counts, known = counted(piece.column(text).to_pylist())
            total[:DIMS] += (counts > 0).sum(axis=0)
            total[DIMS] += known.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def clustered(x: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; centroids and the cluster of each row."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(clusters, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).argmax(axis=1)


def sample(docs: DataFrame, text: str, lang: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` distinct texts per language, those with the smallest hashes."""
    keyed = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = keyed.select("lang", "h").distinct().withColumn("r", place).where(F.col("r") <= most).drop("r")
    return keyed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df = frequencies(docs, text)
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("h")["text"].tolist()
        parts = [counted(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
        x = np.concatenate([vectors(c, idf)[k] for c, k in parts])
        if not len(x):
            return pd.DataFrame({"lang": [], "k": [], "radius": [], "centre": []})
        found, own = clustered(x)
        cosine = (x * found[own]).sum(axis=1)
        rows = [(group["lang"].iloc[0], k, float(np.quantile(cosine[own == k], FARTHEST)), found[k].astype(np.float32).tobytes()) for k in range(len(found)) if (own == k).any()]
        return pd.DataFrame(rows, columns=["lang", "k", "radius", "centre"])

    rows = sample(docs, text, lang).groupBy("lang").applyInPandas(centres, "lang string, k int, radius double, centre binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"].encode("utf-8", "surrogatepass"), r["k"]))
    centroids = np.stack([np.frombuffer(bytes(r["centre"]), np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return Model([r["lang"] for r in rows], centroids, np.array([r["radius"] for r in rows]), idf)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and lang_pred, score, rejected."""
    docs = without(docs, "lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        languages, score, rejected = shared.value.predict(piece.column(text).to_pylist())
        more = [pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*piece.columns, *more], names=[*piece.schema.names, "lang_pred", "score", "rejected"])

    return arrow_map(docs, work, schema, text, limit=BYTES, most=ROWS)


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
