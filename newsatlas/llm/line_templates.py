"""Line dedup by a tree of line templates.

Lines go down a tree of fixed depth: by their number of tokens, then by their first ``DEPTH`` tokens, where a token with
a digit counts as a variable. In a leaf, a token stays part of the template where it stands at its place in lines of at
least ``MIN_DOCS`` texts; every other token becomes a variable field. Lines whose template recurs in ``MIN_DOCS``
different texts are dropped from every document, and so are equal lines of ``LONG`` tokens or more that stand in two
texts which are no near copies (Jaccard of shingles below ``NEAR``, told from the least hashes). Equal texts count as one, so that a copied document does not lose its
lines for being copied.

All steps are counts by key with partial sums; line text moves only for leaves that can still form a template.

Defined results: a null or empty text keeps its value and has no line dropped; lines of fewer than ``MIN_TOKENS`` tokens
are kept; templates with fewer constant tokens than ``MIN_CONSTANT`` of all are not boilerplate, and a line whose mask
has fewer recurs only where its digits recur too; repeated rows are treated alike; an empty table gives no rows; input
columns named like an output column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsatlas.llm.frames import query, table, without
from newsatlas.operators.keys import keep_keys, lookup
from newsatlas.session import cut

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 5
MIN_CONSTANT = 0.6
LONG = 10
NEAR = 0.5
SHINGLE, SKETCH = 5, 64
VARIABLE = "<*>"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
OUTPUT = ["n_lines", "n_dropped"]


def masked(line: Column) -> Column:
    """The line with every token that holds a digit as a variable, and single blanks."""
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"{WORD}*[0-9]{WORD}*", VARIABLE)).otherwise(line)
    return F.btrim(plain, F.lit(" \t\n\x0b\x0c\r"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __text, pos, line, __long, __leaf, __line, n) of each line; n: its tokens."""
    cut_up = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__text"), F.split(text, "\n").alias("lines"))
    each = cut_up.select("__id", "__text", F.posexplode_outer("lines").alias("pos", "raw"))
    blanks = F.translate("line", "\t\n\x0b\x0c\r", " " * 5)
    tokens = F.array_remove(F.split(blanks, " "), "")  # one character: no regular expression runs
    line = each.withColumn("line", masked(F.col("raw"))).withColumn("tokens", tokens).withColumn("n", F.size("tokens"))
    fields = F.when(F.contains("line", F.lit(VARIABLE)), F.size(F.filter("tokens", lambda t: t == VARIABLE))).otherwise(0)
    equal = F.when(F.col("n") - fields >= MIN_CONSTANT * F.col("n"), F.col("line")).otherwise(F.btrim("raw", F.lit(" \t\n\x0b\x0c\r")))
    leaf = F.xxhash64("n", F.slice("tokens", 1, DEPTH))
    return line.select("__id", "__text", "pos", "line", (F.col("n") >= LONG).alias("__long"), leaf.alias("__leaf"), F.xxhash64(equal).alias("__line"), "n")


def templates(spelled: DataFrame, found: DataFrame, frequency: DataFrame) -> DataFrame:
    """(__line, template): the template of every line in a leaf that can still form one."""
    leaves = cut(frequency.where(F.col("n") < MIN_DOCS).groupBy("__leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).select("__leaf"))
    few = spelled.select("__leaf", "__line", "line").join(leaves, "__leaf", "left_semi").groupBy("__leaf", "__line").agg(F.any_value("line").alias("line"))
    spread = few.join(frequency, ["__leaf", "__line"]).select("__leaf", "__line", "n", F.posexplode(F.split("line", f"{SPACE}+")).alias("at", "token"))
    tokens = cut(spread)
    constant = tokens.groupBy("__leaf", "at", "token").agg(F.sum("n").alias("c")).where(F.col("c") >= MIN_DOCS)
    known = tokens.join(constant, ["__leaf", "at", "token"], "left")
    field = F.struct("at", F.when(F.col("c").isNull(), VARIABLE).otherwise(F.col("token")).alias("token"))
    stays = F.col("c").isNotNull() & (F.col("token") != VARIABLE)
    whole = known.groupBy("__leaf", "__line").agg(F.sort_array(F.collect_list(field)).alias("fields"), F.avg(stays.cast("int")).alias("share"))
    return whole.where(F.col("share") >= MIN_CONSTANT).select("__line", F.array_join(F.transform("fields", lambda x: x["token"]), " ").alias("template"))


def sketch(text: Column) -> Column:
    """The least hashes of the shingles of a text; a short text is one shingle."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))

    each = F.transform(F.array(words), hashes)[0]  # bound as an element, else the text is split again for every shingle
    return F.slice(F.array_sort(F.array_distinct(each)), 1, SKETCH)


def near(a: Column, b: Column) -> Column:
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) >= NEAR * F.size(least)


def without_places(text: Column, gone: Column) -> Column:
    """The text without the lines at these places: the stretches between them, joined again."""

    def stretches(line: Column) -> Column:
        borders = F.arrays_zip(
            F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(line))).alias("b")
        )
        return F.flatten(F.transform(borders, lambda x: F.slice(line, x["a"] + 2, x["b"] - x["a"] - 1)))

    return F.array_join(F.transform(F.array(F.split(text, "\n")), stretches)[0], "\n")


def passages(docs: DataFrame, found: DataFrame, frequency: DataFrame, text: str) -> DataFrame:
    """(__line): long lines of 2 to ``MIN_DOCS`` - 1 texts, two of which at least are no near copies."""
    rare = cut(frequency.where(F.col("__long") & F.col("n").between(2, MIN_DOCS - 1)).select("__line"))
    places = cut(keep_keys(found.where("__long").select("__line", "__text"), rare, "__line").distinct())
    own = keep_keys(docs.select(F.xxhash64(text).alias("__text"), F.col(text).alias("t")), places, "__text").groupBy("__text").agg(F.any_value("t").alias("t"))
    sketches = cut(own.select("__text", sketch(F.col("t")).alias("s")))
    lines_ = places.join(sketches, "__text").groupBy("__line").agg(F.collect_list("s").alias("texts"))
    return lines_.where(F.exists("texts", lambda a: F.exists("texts", lambda b: ~near(a, b)))).select("__line")


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines without their text, the hashes ``__line`` of the lines to drop)."""
    spelled = cut(lines(docs, key, text)).where(F.col("n") >= MIN_TOKENS).drop("n")  # a filter before the write would split every line twice
    found = spelled.drop("line")
    frequency = cut(found.select("__leaf", "__line", "__long", "__text").distinct().groupBy("__leaf", "__line", "__long").agg(F.count(F.lit(1)).alias("n")))
    shaped = cut(templates(spelled, found, frequency))
    recurring = found.join(shaped, "__line").select("template", "__text").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    alike = shaped.join(recurring, "template", "left_semi").select("__line")
    often = frequency.where(F.col("n") >= MIN_DOCS).select("__line")
    return found, often.unionByName(alike).unionByName(passages(docs, found, frequency, text)).distinct()


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, ``text`` without its recurring lines, and n_lines, n_dropped."""
    docs = without(docs, *OUTPUT)
    found, drop = boilerplate(docs, key, text)
    hit = lookup(found.select("__id", "__text", "pos", "__line"), cut(drop.withColumn("hit", F.lit(True))), "__line").where("hit")
    places = hit.select("__id", "__text", "pos").distinct().groupBy("__id", "__text").agg(F.sort_array(F.collect_list("pos")).alias("__gone"))
    marked = docs.withColumn("__t", F.xxhash64(text))
    joined = marked.join(places, marked[key].eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__text")), "left")
    kept = without_places(F.col(text), F.col("__gone"))
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )


@query("op5_line_templates")
def op5(spark, sf_dir):
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
