"""CSV files with line breaks inside cells, read by many tasks.

A file is read in splits of lines. Whether a line begins a record depends on the number of quotes before it, which a split
alone cannot know: each split counts its quotes, running sums over the splits of a file tell each with how many it begins,
and sums inside a split do the rest. A line outside quotes whose own quotes are even is a record; only the lines of longer
records are gathered, over split borders too.

Quotes stand around cells and are doubled inside them. Every file begins with the same header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

QUOTE = '"'
OPTIONS = {"escape": QUOTE, "quote": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": "20480"}
BOM = "﻿"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the first record of the first file."""
    return [c.removeprefix(BOM) for c in spark.read.options(header=True, **OPTIONS).csv(path).columns]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line, quotes): ``at`` orders the lines of a split."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", False).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"), F.length(F.regexp_replace("value", f"[^{QUOTE}]", "")).alias("quotes"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, first): the text of every record that is not blank; ``first`` marks the first one of a file."""
    found = lines(spark, path)
    in_file = Window.partitionBy("file").orderBy("split")  # a row per split
    splits = found.groupBy("file", "split").agg(F.sum("quotes").alias("all"))
    splits = splits.select("file", "split", (F.sum("all").over(in_file) - F.col("all")).alias("before"))
    in_split = Window.partitionBy("file", "split").orderBy("at")
    known = found.join(splits, ["file", "split"])
    outside = (F.col("before") + F.sum("quotes").over(in_split) - F.col("quotes")) % 2 == 0
    numbered = known.withColumn("begins", outside).withColumn("no", F.sum(outside.cast("long")).over(in_split))
    single = numbered.where(F.col("begins") & (F.col("quotes") % 2 == 0))
    whole = single.select("file", "line", ((F.col("split") == 0) & (F.col("no") == 1)).alias("first"))
    # Lines before the first record of a split belong to the last record of the last split that begins one.
    pieces = numbered.where(~(F.col("begins") & (F.col("quotes") % 2 == 0))).select("file", "split", "at", "line", "no")
    counts = numbered.groupBy("file", "split").agg(F.max("no").alias("records"))
    last = F.last(F.when(F.col("records") > 0, F.struct("split", "records")), ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    owners = counts.select("file", "split", last.alias("owner"))
    owned = pieces.join(owners, ["file", "split"]).select(
        "file", F.when(F.col("no") > 0, F.col("split")).otherwise(F.col("owner.split")).alias("home"), F.when(F.col("no") > 0, F.col("no")).otherwise(F.col("owner.records")).alias("no"),
        F.struct("split", "at", "line").alias("piece"),
    )
    joined = owned.groupBy("file", "home", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["line"]), "\n").alias("line"))
    long = joined.select("file", "line", ((F.col("home") == 0) & (F.col("no") == 1)).alias("first"))
    text = F.regexp_replace("line", r"\r\z", "")
    out = whole.unionByName(long).select("file", F.when(F.col("first"), F.ltrim(text, F.lit(BOM))).otherwise(text).alias("record"), "first")
    return out.where(F.col("first") | (F.btrim("record") != ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty cell is null. A file with another header than the first is an error."""
    names = header(spark, path)
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = records(spark, path).select("first", F.from_csv("record", kind.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), OPTIONS).alias("r"))
    own = F.transform(F.array(*[F.col(f"r.c{i}") for i in range(len(names))]), lambda c: F.coalesce(c, F.lit("")))
    same = own == F.array(*[F.lit(n) for n in names])
    body = cells.where(F.when(~F.col("first"), F.lit(True)).when(same, F.lit(False)).otherwise(F.raise_error(F.lit(f"another header in {path}")).cast("boolean")))
    return body.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
