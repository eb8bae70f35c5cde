"""Scoring, joins, mixing, sharding and the pipeline against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsatlas.llm import jaccard_join, mixing, near, scoring, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string, n long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "x", None), (3, "a b c d e f", None, "s"), (3, "a b c d e f", None, "s"), (4, "A  b\nC d e f", None, "t"), (5, "one", None, "t"), (6, "One", None, "t"), (None, "null id words here", None, "t"), (7, "long " * 20000, None, "u")]
    return spark.createDataFrame([(*r, "z", "z", 1, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = lower(text)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components(sets):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def test_signatures_never_miss_a_link():
    rng = np.random.default_rng(1)
    often = {}
    for n in (1, 2, 4, 7, 20, 60, 150, 400, 1000):
        for _ in range(20):
            base = np.sort(rng.integers(1, 1 << 63, n).astype(np.uint64))
            most = int(n * 2 // 9)  # replaced tokens that leave a similarity of 80 %
            changed = base.copy()
            changed[rng.permutation(n)[: int(rng.integers(0, most + 1))]] = rng.integers(1, 1 << 63, 1).astype(np.uint64)
            changed = np.unique(changed[: n - int(rng.integers(0, 2))]) if n > 10 else np.unique(changed)
            common = len(np.intersect1d(base, changed))
            if 100 * common < 80 * (len(base) + len(changed) - common):
                continue
            found = []
            for s in (base, changed):
                prefix = s[: int(near.prefix_length(np.array([len(s)]))[0])]
                for t in prefix.tolist():
                    often.setdefault(t, int(rng.choice([2, 3, 50, 65, 500, 500, 500])))
                found.append(set(near.signatures(prefix, np.array([often[t] for t in prefix.tolist()]), len(s)).tolist()))
            assert found[0] & found[1], n


def test_join_matches_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = lower(rows[7][1])[:150]
    rng = np.random.default_rng(3)
    for k in range(150):  # near copies of one text, many of which link only through others
        w = list(words)
        for at in rng.integers(0, len(w), 4):
            w[at] = f"new{k}"
        rows.append((1000 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = sets_of(rows)
    expected = components(sets)
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(odd).collect())
    assert found == Counter([(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (4, 2, 3), (5, 1, 5), (6, 1, 5), (None, 1, None), (7, 1, 7)])
    assert jaccard_join.join(none).count() == 0
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7]


def test_remaining_blocks_find_links_the_pivots_missed(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = sets_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == components(sets)


def test_scores_match_brute_force_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 10 != 0
    rows = {r["doc_id"]: r for r in scoring.score(docs, learn).collect()}
    texts = {r["doc_id"]: [*lower(r["text"]), ""] for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if i % 10 for w in t)
    n = sum(count.values())
    for i, t in texts.items():
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(t), sum(w in count for w in t), n)
        assert rows[i]["base_score"] == pytest.approx(sum(log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in t))
    held = [i for i in texts if i % 10 == 0]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)
    again = {r["doc_id"]: r["score"] for r in scoring.score(docs, learn).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}
    assert sorted(r["n_tokens"] for r in scoring.score(odd, F.lit(True)).collect()) == sorted(len(lower(r["text"])) + 1 for r in odd.collect())
    assert {r["n_known"] for r in scoring.score(odd, F.lit(False)).collect()} == {0}
    assert scoring.score(none, F.lit(True)).count() == 0


def test_predictive_probabilities_sum_to_one():
    totals = scoring.Totals(3, 10, 4, (0.6, 0.4))
    c = np.array([[3, 0, 1], [0, 2, 1], [1, 0, 0], [2, 0, 0]])
    t = np.array([[2, 0, 1], [0, 1, 1], [1, 0, 0], [1, 0, 0]])
    c0, t0 = t.sum(axis=1), np.array([2, 1, 1, 1])
    totals.customers, totals.tables = np.r_[c.sum(axis=0), c0.sum()], np.r_[t.sum(axis=0), t0.sum()]
    parent = totals.parent(np.r_[c0, 0], np.r_[t0, 0])
    assert parent.sum() == pytest.approx(1)
    for k in range(3):
        p = totals.predict(np.full(5, k), np.r_[c[:, k], 0], np.r_[t[:, k], 0], parent)
        assert p.sum() == pytest.approx(1)


def test_table_counts_follow_their_exact_distribution():
    d, others, base, c = 0.5, 7, 0.2, 5
    stirling = scoring.log_stirling(d, scoring.EXACT)
    weight = [np.exp(stirling[c, k]) * np.prod([(scoring.STRENGTH + d * (others + i)) * base for i in range(k)]) for k in range(1, c + 1)]
    n = 200_000
    t = scoring.seated(np.full(n, c), np.full(n, others), np.full(n, base), d, stirling, np.random.default_rng(0))
    seen = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(seen - np.array(weight) / sum(weight)).max() < 0.006
    assert 1 <= scoring.seated(np.array([10_000]), np.array([50]), np.array([0.01]), d, stirling, np.random.default_rng(0))[0] < 10_000


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_targets():
    rows = mixing.targets([(None, 10), ("b", 100), ("a", 1000), ("é", 50)])
    assert [r[1] for r in rows] == ["a", "b", "é", None]
    total = 1.5 * 1160
    assert sum(r[3] for r in rows) == pytest.approx(total) and all(r[3] <= 2 * r[2] for r in rows)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)])[0][3] == 0


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.shares(docs).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    assert len(rows) == docs.count()
    assert all(abs(taken - target) <= mixing.BLOCK for _, taken, target in by.values())
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.shares(docs).collect()))
    pieces = mixing.mix(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n"), F.collect_set("shard").alias("shards")).collect()
    assert {r["doc_id"]: (r["n"], sorted(r["shards"])) for r in pieces} == {r["doc_id"]: (r["taken"], r["shards"]) for r in rows if r["taken"]}
    assert all(bool(r["taken"]) == bool(r["shards"]) for r in rows)
    found = mixing.shares(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert mixing.shares(none).count() == 0 and mixing.mixed(none).columns == none.columns


def test_sharding(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.limit(1).crossJoin(spark.range(400)).select(F.col("id").alias("doc_id"), "text", "lang", "source", "n_chars")
    for table in (docs, docs.unionByName(hot), odd):
        rows = sharding.shard(table).select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
        assert len(rows) == table.count()
        bytes_, slots = Counter(), defaultdict(list)
        for r in rows:
            data = (r["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data)) and 0 <= r["shard"] < 8
            bytes_[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(r["size"] for r in rows)
        assert max(bytes_.values()) <= sum(bytes_.values()) / 8 + largest + 1
    assert sharding.shard(none).count() == 0


def test_keep_first_loses_no_group(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (None, text("d") + " more"), (2, text("c")), (2, text("e")), (2, text("e")), (3, ""), (3, ""), (None, None), (4, " \n")]
    kept = jaccard_join.keep_first(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, label string"))
    assert kept.columns == ["doc_id", "text", "fp", "label"]
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert found == Counter([(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("e")), (3, ""), (3, ""), (None, None), (4, " \n")])


def test_pipeline(spark, none):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert copies and max(copies.values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in out.select("doc_id", "text").collect())
    sets = sets_of([(i, texts[i]) for i in copies])
    assert components(sets) == {i: i for i in sets}  # no two near copies are left
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
        if name != "sharding":
            assert empty.columns == docs.columns


def test_every_word_has_a_context_of_its_own(spark):
    # 600 rare words, each of which is followed by its own word: the word before tells the word, its ending doesn't
    pairs = [(f"left{k}end", f"right{k}") for k in range(600)]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(w for k in rng.permutation(600) for w in pairs[k])) for i in range(6)]
    seen = " ".join(w for p in pairs for w in p)
    swapped = " ".join(w for k in range(600) for w in (pairs[k][0], pairs[(k + 7) % 600][1]))
    docs = spark.createDataFrame([*rows, (10, seen), (11, swapped)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score(docs, F.col("doc_id") < 10).collect()}
    assert got[10]["base_score"] == pytest.approx(got[11]["base_score"])
    assert (got[10]["score"] - got[11]["score"]) / 600 > 1  # ten times as probable a word at least
