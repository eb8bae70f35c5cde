"""Resampling, collocations and token files against brute force, round trips, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from newsatlas.llm import collocations, resampling, token_files
from newsatlas.session import scratch_dir

SCHEMA = "doc_id long, text string, lang string, rank string, score string, part string, ids string, start string"
ODD = [None, "", " \t\n", "one", "a b c d", "x " * 9, "x " * 300, "same, line\nsame line.\n\nsame line", "é ü ñ\n\n word  ", "A B   c　 d", "\x00 \x0b\x0c z <|endoftext|> z", "word " * 30000, "don't  stop\r\n\t now\n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], "r", "s", "p", "i", "s") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, "null id here " * 30, "en", "r", "s", "p", "i", "s"), (-5, "low id", "en", "r", "s", "p", "i", "s")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(words, longest):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, longest=1, buckets=10_000):
    def place(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(place(f) for x in side for f in runs(plain(x), longest)) for side in ([x for _, x in docs], target))
    size, goal = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        words = plain(text)
        weight = sum(gain[place(f)] for f in runs(words, longest))
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(runs(words, longest)), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = Counter((x[0], x[3], i + 1) for i, x in enumerate(able[: 10 * len(able) // 100]))
    return Counter((*x[:4],) for x in out), drawn


def check_resample(found, docs, target, longest=1):
    rows, drawn = brute_resample(docs, target, longest)
    got = found.collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    assert Counter((r["doc_id"], r["score"], r["rank"]) for r in got if r["rank"] is not None) == drawn


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_matches_brute_force(spark, odd, longest):
    sf = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [x["text"] for x in target.collect()]
    check_resample(resampling.resample(docs, target, longest=longest), [(r["doc_id"], r["text"]) for r in docs.collect()], texts, longest)
    check_resample(resampling.resample(odd, target, longest=longest), [(r["doc_id"], r["text"]) for r in odd.collect()], texts, longest)


def test_resampling_of_empty_tables(none, odd):
    assert resampling.resample(none, odd).count() == 0
    check_resample(resampling.resample(odd, none), [(r["doc_id"], r["text"]) for r in odd.collect()], [])


def test_radix_places_are_those_of_a_sort(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 4)
    draw = random.Random(7)
    values = [(draw.choice([-(1 << 63), (1 << 63) - 1, 0, -1, draw.randrange(-5000, 5000)]), draw.randrange(50) - 25) for _ in range(700)]
    rows = spark.createDataFrame(values, "a long, b long").repartition(5)
    placed = resampling.radix_places(rows, [resampling.ordered(F.col("a"), True), resampling.ordered(F.col("b"))])
    got = [(r["a"], r["b"]) for r in sorted(placed.collect(), key=lambda r: r["__place"])]
    assert got == sorted(values, key=lambda x: (-x[0], x[1]))
    assert sorted(r["__place"] for r in placed.collect()) == list(range(700))


def brute_phrases(docs, longest=4, least=30, top=2000):
    f, n = {}, Counter()
    for text, lang in docs:
        counts = f.setdefault(lang or "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts.update(runs(words, longest))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if c >= least and " " in p}
        held = {}
        for p, c in found.items():
            words = p.split(" ")
            for part in {" ".join(words[i : i + k]) for k in range(2, len(words)) for i in range(len(words) - k + 1)}:
                held[part] = max(held.get(part, 0), c)
        rows = []
        for p, a in found.items():
            if 100 * held.get(p, 0) >= 80 * a and p in held:
                continue
            words = p.split(" ")
            cuts = [(counts[" ".join(words[:k])], counts[" ".join(words[k:])]) for k in range(1, len(words))]
            score, k = min((2_000_000 * a // (l + r), k) for k, (l, r) in enumerate(cuts))
            rows.append((p, a, *cuts[k], n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return sorted(out)


def phrase_rows(found):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())


def test_collocations_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute_phrases([(r["text"], r["lang"]) for r in docs.collect()])
    assert expected and phrase_rows(collocations.collocations(docs.repartition(5))) == expected


def test_collocations_of_odd_rows(spark, odd, none, monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", "C", "d d", "ê"]) + draw.choice([" ", "\t", "  ", ", ", "\n"]) for _ in range(draw.randrange(200))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, draw.choice(["x", None, "und"])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    every = rows.unionByName(odd.select("doc_id", "text", "lang"))
    expected = brute_phrases([(r["text"], r["lang"]) for r in every.collect()], least=3, top=7)
    for bits in (20, 6):  # a full bit table lets every phrase pass
        monkeypatch.setattr(collocations, "LEAST_BITS", max(bits, 15))
        monkeypatch.setattr(collocations, "MOST_BITS", max(bits, 15))
        assert phrase_rows(collocations.collocations(every, min_count=3, top=7, shards=2)) == expected
    assert collocations.collocations(none).count() == 0


def test_phrases_of_equal_hash_are_told_apart(monkeypatch):
    ids = np.array([0, 1, 0, 2, 0, 1])
    at = np.array([0, 2, 4])
    codes, first = collocations._distinct(at, np.zeros(3, np.uint64), np.zeros(3, np.uint64), ids, 2)
    assert codes.tolist() == [0, 1, 0] and first.tolist() == [0, 2]


def test_cohesion_is_exact(spark):
    big = [(6_000_000_000_000_000_000, 6_100_000_000_000_000_000, 9_000_000_000_000_000_001), (1, 3, 3), (30, 30, 30), (999_999, 1_000_000, 999_999_999)]
    rows = spark.createDataFrame(big, "a long, l long, r long")
    got = rows.select(collocations.cohesion(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [2_000_000 * a // (l + r) for a, l, r in big]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own, public_tokenizers.path("byte_bpe_50k.json")


def test_cuttings_encode_like_whole_texts():
    own, path = tokenizer()
    encoder = token_files.Encoder(open(path, encoding="utf-8").read())
    assert encoder.separable
    draw = random.Random(11)
    alphabet = [" ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x1c", "a", "Bc", "don't", "'s", "42", "é", "日本", "😀", "́", "...", "<|endoftext|>", "​", "ſ", " "]
    texts = [None, "", " ", *["".join(draw.choices(alphabet, k=draw.randrange(1, 40))) for _ in range(3000)]]
    found = encoder.encode(pa.array(texts)).to_pylist()
    assert found == [own.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_token_files_round_trip(spark, odd, none):
    own, path = tokenizer()
    out = scratch_dir(spark, "tokens")
    token_files.write(odd, out, path)
    files = token_files.read(spark, out)
    kept = files.orderBy("part", "first").collect()
    order = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [(r["doc_id"], r["ids"]) for r in kept] == [(r["doc_id"], own.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in order]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(files).collect())
    before = 0
    for r, (start, key, n, crc) in zip(order, got):
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert (start, key, n, crc) == (before, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    empty = scratch_dir(spark, "tokens")
    token_files.write(none, empty, path)
    assert token_files.digests(spark.read.schema(files.schema).orc(empty)).count() == 0


def test_token_files_have_stripes_and_indexes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 14)
    _, path = tokenizer()
    docs = spark.range(0, 40000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    token_files.write(docs, f"{tmp_path}/t", path)
    parts = sorted((tmp_path / "t").glob("*.orc"))
    opened = [pyarrow.orc.ORCFile(p) for p in parts]
    assert all(f.nstripes > 1 and f.row_index_stride == token_files.ROW_GROUP for f in opened)
    orc = spark._jvm.org.apache.orc.OrcFile
    reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(parts[0])), orc.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = Counter(footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount()))
    assert kinds["BLOOM_FILTER_UTF8"] == 1 and kinds["ROW_INDEX"] == 7  # the Bloom filter is that of the id
    assert {footer.getColumns(i).getKind().toString() for i in (1, 2, 3, 4, 6)} == {"DIRECT_V2"}  # run-length encoded whole numbers
    wanted = token_files.read(spark, f"{tmp_path}/t").where(F.col("doc_id").isin(3, 25000))
    assert sorted(r["doc_id"] for r in wanted.collect()) == [3, 25000]
    assert re.search(r"PushedFilters: \[In\(doc_id", spark._jvm.PythonSQLUtils.explainString(wanted._jdf.queryExecution(), "formatted"))


def test_tasks_of_a_process_share_an_encoder():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    first = token_files.encoder(text, 0)
    column = pa.array(["the same words", None, "", "the same words again"])
    ids = first.encode(column).to_pylist()
    known = len(first.known)
    assert known and token_files.encoder("".join(list(text)), 0) is first
    assert first.encode(column).to_pylist() == ids == token_files.Encoder(text, 0).encode(column).to_pylist() and len(first.known) == known
