"""The stored n-gram index: cells counted in chunks and stored packed are those of the index made cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from newsatlas.operators import gram_cells, search


def texts(accented: bool):
    rng = random.Random(11)
    words = ["operacao", "estrela", "a", "ab", "xyz", "porto-seguro", "12", "selva"] + (["ação", "çé"] if accented else [])
    rows = [(f"l{i % 70}", rng.choice(["  ", " ", "\t", "\x1c\n"]).join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(80)]
    return rows + [("empty", ""), ("none", None), (None, "texto sem link")]


@pytest.mark.parametrize("accented", [False, True])
def test_packed_cells_are_those_of_the_index(spark, monkeypatch, accented):
    monkeypatch.setattr(gram_cells, "CHUNK_BYTES", 900)
    df = spark.createDataFrame(texts(accented), "link string, t string").repartition(3)
    plain = lambda rows: sorted(map(tuple, rows.select(F.coalesce("link", F.lit("?")), "gram", F.round("weight", 9), F.round("idf", 9)).collect()))
    store = search.store_index(df, "link", "t")
    whole = plain(search.gram_index(df, "link", "t"))
    assert plain(store.rows()) == whole
    held = store.stored("postings").where("part > 0")
    assert held.agg(F.sum("n")).first()[0] == len(whole) and (accented or held.count() < len(whole) / 4)
    some = plain(store.read("postings", [" op", "estre"]))
    assert some and some == [r for r in whole if r[1] in (" op", "estre")]


def test_chunks_hold_every_text_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(gram_cells, "CHUNK_BYTES", 50)
    monkeypatch.setattr(gram_cells, "CHUNK_TEXTS", 6)
    numbers = [*range(20), *range(1000, 1003), 5, 6, 2000]
    batches = [pa.RecordBatch.from_pydict({"no": numbers[a : a + 8], "text": ["x" * (n % 13 * 7) for n in numbers[a : a + 8]]}) for a in range(0, len(numbers), 8)]
    found = list(gram_cells.chunks(batches))
    assert [int(n) for ns, _ in found for n in ns] == numbers
    assert all(0 <= n - ns[0] <= 6 for ns, _ in found for n in ns)
    assert all(sum(map(len, ts)) == len(ns) for ns, ts in found)
