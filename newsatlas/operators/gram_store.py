"""A stored n-gram index that answers a query from the ranges of its grams.

Postings lie in folders of neighbouring grams, sorted by gram, so that a scan opens the folders of the query's grams and in
them only the row groups and pages that hold these. A row holds the cells of a gram in a chunk of texts: places of texts
counted from the chunk's first number, and what the cells hold. The weight of a cell is that times the idf of the gram and
the scale of the text, which is stored once. For each folder and gram the number and the largest weight of its postings are kept.

A search for scores above a floor ends early: the grams of least effect, whose largest weights together stay below the
floor, cannot lift a text over it alone. Their long lists are read only for texts that another gram has brought up, and
only those whose score so far and the rest at its best reach the floor. The scores found are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.operators import gram_cells
from newsatlas.session import cut

RANGES = 64
ROW_GROUP_BYTES = 4 << 20
DIGITS = 6
SLACK = 2e-6  # scores are compared after rounding
MOST_GRAMS, MOST_TEXTS = 4_000_000, 1_000_000  # rows that may travel to the tasks
#: A gram in a chunk of texts; ``part`` is its range, and 0 where a row holds the scales of a chunk's texts instead.
POSTING = {"gram": "string", "idf": "double", "top": "double", "n": "long", "base": "long", "texts": "array<short>", "held": "array<double>"}


def spelled(text: str, low: int, high: int) -> Counter:
    """n-grams inside the words of a folded text, each word padded with one blank on both sides."""
    out: Counter = Counter()
    for word in text.split():
        padded = f" {word} "
        out.update(padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1))
    return out


@dataclass
class Term:
    gram: str
    weight: float  # of the query, unit length
    most: float  # what it adds to a score at best
    postings: int


@dataclass
class GramStore:
    spark: SparkSession
    path: str
    key: str
    kind: str  # type of the key
    borders: list[tuple[int, str, str]]  # folder, least and greatest gram; at most RANGES rows

    @staticmethod
    def write(index: DataFrame, path: str, key: str, ranges: int = RANGES) -> GramStore:
        """Store the rows (key, gram, weight, idf). A gram of very many texts may fill several ranges.

        The rows are written out first, since finding the borders of the ranges reads them once more.
        """
        rows = cut(index.select(key, "gram", "weight", "idf"))
        texts = cut(rows.select(key).distinct().select(key, F.monotonically_increasing_id().alias("no"), F.lit(1.0).alias("scale")))
        cells = rows.join(texts.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).select(
            "gram", "idf", F.col("weight").alias("top"), F.lit(1).cast("long").alias("n"), F.col("no").alias("base"),
            F.array(F.lit(0).cast("short")).alias("texts"), F.array(F.col("weight") / F.col("idf")).alias("held"),
        )
        placed = cells.repartitionByRange(ranges, "gram", "base").withColumn("part", F.spark_partition_id() + 1)
        return GramStore.finish(placed.select(*POSTING, "part"), texts, path, key, ranges)

    @staticmethod
    def write_texts(texts: DataFrame, total: int, path: str, key: str, grams: tuple[int, int], ranges: int = RANGES) -> GramStore | None:
        """Store the TF-IDF cells of (no, key, text), one row a key, from ``total`` documents; ``no`` rises in each partition.

        Cells are counted by sorting in chunks of texts, once for the idf and once with it, and travel packed. None where
        texts are not plain ASCII or have more distinct n-grams than may travel to the tasks.
        """
        sc = texts.sparkSession.sparkContext

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for numbers, rows in gram_cells.chunks(batches):
                if gram_cells.plain(rows):
                    found = gram_cells.cells(numbers, rows, *grams)
                    yield pa.RecordBatch.from_arrays([pa.array(found.codes), pa.array(found.sizes())], names=["code", "df"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([1], pa.int64())], names=["code", "df"])

        counted = texts.select("no", "text").mapInArrow(count, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
        stats = cut(counted)
        if stats.where("code < 0").count() or stats.count() > MOST_GRAMS:
            return None
        known = stats.orderBy("code").toArrow()
        codes, df = (known.column(c).to_numpy() for c in ("code", "df"))
        borders = codes[np.searchsorted(np.cumsum(df), np.arange(1, ranges) * (df.sum() / ranges))] if len(codes) else codes
        shared = sc.broadcast((codes, np.log((1.0 + total) / (1.0 + df)) + 1.0, borders))

        def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, idf, borders = shared.value
            for numbers, rows in gram_cells.chunks(batches):
                found = gram_cells.cells(numbers, rows, *grams)
                own, sizes, base = idf[np.searchsorted(codes, found.codes)], found.sizes(), int(numbers[0])
                w = found.tf * np.repeat(own, sizes)
                norm = np.sqrt(np.bincount(found.text, w * w, len(numbers)))
                scale = 1.0 / np.where(norm > 0, norm, np.inf)
                top = np.maximum.reduceat(w * scale[found.text], found.starts) if len(w) else w
                place = (numbers - base).astype(np.int16)
                ends = np.r_[found.starts, len(w)].astype(np.int32)
                yield packed([None], [1.0], [0.0], [len(numbers)], base, [0, len(numbers)], place, scale, [0])
                yield packed(gram_cells.spelled_out(found.codes), own, top, sizes, base, ends, place[found.text], found.tf, 1 + np.searchsorted(borders, found.codes))

        def packed(gram, idf, top, n, base, ends, places, held, part) -> pa.RecordBatch:  # noqa: ANN001
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(places, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(held, pa.float64()))]
            columns = [pa.array(gram, pa.string()), pa.array(idf, pa.float64()), pa.array(top, pa.float64()), pa.array(n, pa.int64()), pa.array([base] * len(n), pa.int64()), *lists]
            return pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.int32())], names=[*POSTING, "part"])

        rows = texts.select("no", "text").mapInArrow(weigh, ", ".join(f"{c} {t}" for c, t in POSTING.items()) + ", part int")
        dealt = rows.repartitionById(ranges + 1, F.col("part"))
        stored = GramStore.postings(dealt, path)
        scales = stored.where("part = 0").select(F.posexplode("held").alias("at", "scale"), "base", "texts")
        scales = scales.select((F.col("base") + F.get("texts", F.col("at"))).alias("no"), "scale")
        return GramStore.finish(None, texts.select("no", key).join(scales, "no").select(key, "no", "scale"), path, key, ranges)

    @staticmethod
    def postings(rows: DataFrame, path: str) -> DataFrame:
        ordered = rows.sortWithinPartitions("part", "gram")
        ordered.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
        return GramStore(rows.sparkSession, path, "", "", []).stored("postings")

    @staticmethod
    def finish(postings: DataFrame | None, texts: DataFrame, path: str, key: str, ranges: int) -> GramStore:
        """Write what belongs to the postings: texts, facts of the grams, and the borders of the ranges."""
        spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
        if postings is not None:
            GramStore.postings(postings, path)
        texts.withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{path}/texts")
        spark.createDataFrame([(key, kind)], "key string, kind string").coalesce(1).write.parquet(f"{path}/about")
        rows = GramStore(spark, path, key, kind, []).stored("postings").where("part > 0")
        grams = rows.groupBy("part", "gram").agg(F.max("top").alias("top"), F.any_value("idf").alias("idf"), F.sum("n").alias("n"))
        grams.repartition(ranges, "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/grams")
        found = GramStore(spark, path, key, kind, []).stored("grams").groupBy("part").agg(F.min("gram").alias("low"), F.max("gram").alias("high"))
        found.coalesce(1).write.parquet(f"{path}/borders")  # a row per range
        return GramStore.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> GramStore:
        borders = spark.read.schema("part int, low string, high string").parquet(f"{path}/borders").collect()
        key, kind = spark.read.parquet(f"{path}/about").first()
        return GramStore(spark, path, key, kind, sorted(tuple(r) for r in borders))

    def stored(self, kind: str, parts: list[int] | None = None) -> DataFrame:
        """``postings``, ``grams`` or ``texts``, of all folders or of some."""
        own = {
            "postings": ", ".join(f"{c} {t}" for c, t in POSTING.items()), "grams": "gram string, top double, idf double, n long",
            "texts": f"`{self.key}` {self.kind}, no long, scale double",
        }
        base = f"{self.path}/{kind}"
        paths = [base] if parts is None else [f"{base}/part={p}" for p in parts]
        return self.spark.read.schema(own[kind] + ", part int").option("basePath", base).parquet(*paths)

    def texts(self) -> DataFrame:
        """(key, no, scale), one row a text."""
        return self.stored("texts").drop("part")

    def weighed(self, cells: DataFrame) -> DataFrame:
        """Cells with the key and the weight they have in their text. Up to MOST_TEXTS texts travel to the cells."""
        texts = self.texts()
        return cells.join(F.broadcast(texts) if texts.count() <= MOST_TEXTS else texts, "no").select(
            self.key, "gram", (F.col("held") * F.col("idf") * F.col("scale")).alias("weight"), "idf"
        )

    def rows(self) -> DataFrame:
        """The whole index: (key, gram, weight, idf)."""
        return self.weighed(_cells(self.stored("postings").where("part > 0")))

    def cells(self, grams: list[str]) -> DataFrame | None:
        """(no, gram, idf, held) of these grams from the folders that may hold them."""
        rows = self.found("postings", grams)
        return None if rows is None else _cells(rows)

    def found(self, kind: str, grams: list[str]) -> DataFrame | None:
        """Stored rows of these grams. Single equalities reach the scan, a long list would not."""
        parts = [p for p, low, high in self.borders if any(low <= g <= high for g in grams)]
        if not parts:
            return None
        return self.stored(kind, parts).where(reduce(lambda a, b: a | b, [F.col("gram") == g for g in grams]))

    def read(self, kind: str, grams: list[str]) -> DataFrame | None:
        """``postings`` of these grams as (key, gram, weight, idf), or what is stored of them in ``grams``."""
        rows = self.found(kind, grams)
        return rows if rows is None or kind != "postings" else self.weighed(_cells(rows))

    def terms(self, query: Counter) -> list[Term]:
        """What the index knows of the query's grams, one row each, the least effective first."""
        rows = self.read("grams", sorted(query))
        if rows is None:
            return []
        known = rows.groupBy("gram").agg(F.max("top").alias("top"), F.any_value("idf").alias("idf"), F.sum("n").alias("n")).collect()
        norm = sqrt(sum((query[r["gram"]] * r["idf"]) ** 2 for r in known))
        own = [(r, query[r["gram"]] * r["idf"] / norm) for r in known]
        return sorted((Term(r["gram"], w, w * r["top"], r["n"]) for r, w in own), key=lambda t: (t.most, t.gram))

    def split(self, terms: list[Term], floor: float) -> tuple[list[Term], list[Term], float]:
        """Terms that a text above the floor may lack all of, the others, and the most that the first can add."""
        rest = 0.0
        for i, term in enumerate(terms):
            if rest + term.most >= floor - SLACK:
                return terms[:i], terms[i:], rest
            rest += term.most
        return terms, [], rest

    def contributions(self, terms: list[Term]) -> DataFrame:
        """(no, s): what these terms add to the scores of texts, before their scale."""
        weights = self.spark.createDataFrame([(t.gram, t.weight) for t in terms], "gram string, q double")
        rows = self.cells([t.gram for t in terms])
        return rows.join(F.broadcast(weights), "gram").select("no", (F.col("held") * F.col("idf") * F.col("q")).alias("s"))

    def scores(self, query: Counter, floor: float = 0.0) -> DataFrame:
        """(key, score) of every text whose rounded score is above 0 and reaches the floor."""
        light, heavy, rest = self.split(self.terms(query), floor)
        if not heavy:
            return self.spark.createDataFrame([], f"`{self.key}` {self.kind}, score double")
        total = self.contributions(heavy).groupBy("no").agg(F.sum("s").alias("s"))
        if light:
            able = total.join(self.texts().select("no", "scale"), "no").where(F.col("s") * F.col("scale") + rest >= floor - SLACK).select("no", "s")
            more = self.contributions(light).join(able.select("no"), "no", "left_semi")
            total = able.unionByName(more).groupBy("no").agg(F.sum("s").alias("s"))
        score = F.round(F.col("s") * F.col("scale"), DIGITS)
        return total.join(self.texts(), "no").select(self.key, score.alias("score")).where((F.col("score") >= floor) & (F.col("score") > 0))


def _cells(rows: DataFrame) -> DataFrame:
    held = rows.select("gram", "idf", "base", F.inline(F.arrays_zip("texts", "held")))
    return held.select((F.col("base") + F.col("texts")).alias("no"), "gram", "idf", "held")
