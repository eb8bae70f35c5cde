"""Quality, language, archives, page text, decontamination: brute force, round trips, and odd inputs."""

import base64
import hashlib
import re
from collections import Counter

import pytest

from newsatlas.llm import decontaminate, html_text, language, line_templates, quality, warc
from newsatlas.llm.words import words

import pyarrow as pa

ODD = [None, "", " \t\n", "one", "a b c d", "x " * 9, "x " * 30, "same line\nsame line\n\nsame line", "é ü ñ\n\n word", "A" * 40 + " " + "B" * 40, "\x00 \x0b\x0c z", "word " * 30000]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, failed string, score string, text_crc32 string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, "w", "f", "s", "c") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "null id here", "en", "s", "w", "f", "s", "c")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_match_a_regular_expression():
    found = words(pa.array(ODD))
    names = found.names.to_pylist()
    for i, text in enumerate(ODD):
        own = [names[k].decode() for k in found.ids[found.bounds[i] : found.bounds[i + 1]]]
        assert own == plain(text)


def measured(text):
    w = plain(text)
    seen, again, lines = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set(), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    twice = 0
    for line in (text or "").split("\n"):
        if plain(line):
            twice += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(again)


def test_quality_measures_match_brute_force(odd):
    rows = quality.ledger(odd).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[1:6]) == measured(r["text"])
        assert bool(r["failed"] & 1) == (r["n_words"] < 10)


def test_quality_keeps_own_columns_and_counts_ablations(odd, none):
    kept = quality.kept(odd)
    assert kept.columns == odd.columns and {r["n_words"] for r in kept.collect()} <= {"w"}
    rows = {r["rule"]: r for r in quality.ablations(quality.ledger(odd)).collect()}
    entries = quality.ledger(odd).collect()
    for i, name in enumerate(quality.RULES):
        assert rows[name]["failed"] == sum(e["failed"] >> i & 1 for e in entries)
        assert rows[name]["only_this"] == sum(e["failed"] == 1 << i for e in entries)
    assert quality.ledger(none).count() == 0 and quality.kept(none).columns == none.columns


def test_language_of_held_out_texts(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs.where("doc_id % 3 <> 1"))
    found = language.identify(docs.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.identify(none, model).count() == 0
    blank = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(odd, blank).collect()} == {"und"}


def test_archive_round_trip(spark):
    pages = [(1, "http://a", "same"), (5, "http://b\r\nX: y", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "é", "größe" * 50000), (9, "é", "größe" * 50000), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.read(warc.write(df)).collect()
    assert len(rows) == len(pages) and all(r["error"] is None for r in rows)
    largest = {}
    for i, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    for i, _, html in pages:
        body = (html or "").encode()
        own = [r for r in rows if r["record_id"] == f"<urn:page:{'' if i is None else i}>"]
        assert own and all(r["payload_bytes"] == len(body) and r["payload_digest"] == digest(body) for r in own)
        first = i is None or largest[html or ""] == i
        assert all(r["record_type"] == ("response" if first else "revisit") for r in own)
        assert all(r["payload"] == (body if first else None) for r in own)
        assert all(r["refers_to_id"] == (None if first else f"<urn:page:{largest[html or '']}>") for r in own)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_long_addresses_cost_no_record(spark):
    pages = [(1, "http://" + "a" * (3 << 20), "first", "clash"), (2, "http://b", "second", "clash")]
    rows = warc.read(warc.write(spark.createDataFrame(pages, "page_id long, url string, html string, payload_bytes string"))).collect()
    assert sorted((r["uri"], r["payload"], r["error"]) for r in rows) == [(pages[0][1], b"first", None), (pages[1][1], b"second", None)]


def test_broken_archives_are_reported(tmp_path):
    good = warc.record(1, "u", b"payload", None)
    for name, data, records in (("cut", good + good[:-20], 1), ("noise", good + b"noise", 1), ("flipped", good.replace(good[40:44], b"zzzz"), 0)):
        path = tmp_path / name
        path.write_bytes(data)
        rows = list(warc.records(str(path)))
        assert rows[-1]["error"] and sum(r["error"] is None for r in rows) == records


PAGE = """<html><body class="has-sidebar"><header><h2>Site</h2><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>First &lt;b&gt; <a href="x>y">link</a>&nbsp;text.<p>Two<br>lines<ul><li>item</li></ul><div class="ad">buy</div>
<aside>Related</aside><form><label>Mail</label></form><script>if(a<b){"</p>"}</script></article><section id="comments"><article><p>Nice!</p></article></section></main>
<div class="sidebar">side</div><footer>(c)</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst <b> link text.\n\nTwo lines\n\nitem"
    for page, text in ((None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("<!-- x", ""), ("<script>x", ""), ("<p>1 &amp;lt; 2</p>", "1 &lt; 2")):
        assert html_text.main_text(page) == text
    assert all(html_text.trained().decide(r) == bool(r[-1]) for r in html_text.LABELLED)


def test_page_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    for r in html_text.extract(pages.withColumnRenamed("html", "page"), "page").join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def distance(pattern, text):
    """Least edit distance of the pattern to any piece of the text."""
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def test_decontamination_matches_brute_force(spark, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)  # noqa: E731  only A-Z lose their case
    items = {r["item_id"]: lower(r["text"]).split() for r in bench.collect()}
    edited = []
    for i, (item, w) in enumerate(sorted(items.items())):
        for errors in (0, 1, decontaminate.budget(len(w)), decontaminate.budget(len(w)) + 3):
            v = list(w)
            for e in range(errors):
                at = (e * 7 + i) % len(v)
                v = v[:at] + [["zz"], [], ["zz", v[at]]][e % 3] + v[at + 1 :]
            edited.append((len(edited), re.sub("[a-z]", lambda m: m[0].upper(), " ".join(["pre"] * i + v + ["post"] * 3))))
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(docs, bench).collect()}
    expected = {}
    for i, text in edited:
        for item, w in items.items():
            d = distance(w, lower(text).split())
            if d <= decontaminate.budget(len(w)):
                expected[i, item] = d
    assert got == expected
    blocks = decontaminate.BLOCK_WORDS
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {i for i, _ in edited} - {i for i, _ in expected}
    assert blocks and decontaminate.matches(odd, bench).count() == 0 and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_line_templates(spark, odd, none):
    rows = [(i, f"User {100 + i} logged in from host{i}\nown line of document alpha{'abcdefghijkl'[i] * 3} beta\nkept {i}") for i in range(12)]
    rows += [(50 + i, "fixed line of boilerplate text\nunique words " + "qwertyuiop"[i] * 4 + " end " + "asdfghjklz"[i] * 3) for i in range(5)]
    rows += [(90 + i, "a copied document stands here\nwith two lines of text") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    out = {r["id"]: r for r in line_templates.drop_recurring(docs, "id").collect()}
    assert all(out[i]["text"] == f"kept {i}" and out[i]["n_dropped"] == 2 for i in range(12))
    assert all(out[50 + i]["n_dropped"] == 1 and out[50 + i]["text"].startswith("unique words") for i in range(5))
    assert all(out[90 + i]["n_dropped"] == 0 for i in range(9))  # copies of one text are no recurrence
    same = line_templates.drop_recurring(odd)
    assert sorted(str(r["text"]) for r in same.collect()) == sorted(str(r["text"]) for r in odd.collect())
    assert line_templates.drop_recurring(none).count() == 0


def test_rows_of_numbers_are_no_boilerplate(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    rows = [(i, f"{i}2 3{i} 5{i}6\n2019-01-0{i + 1} {i}7 {i}9\nTel 555 1234 0000\nowned by {w}") for i, w in enumerate(words)]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert out[i]["text"] == text.replace("Tel 555 1234 0000\n", "") and out[i]["n_dropped"] == 1  # equal digits recur


def test_long_lines_of_two_texts(spark):
    passage = "this passage of more than ten words stands in two texts that share nothing else at all"
    other = "another long line that two near copies of one and the same text have in common here"
    more = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, f"first text of all\n{passage}\n" + " ".join(f"one{c}" for c in "abcdefghijklmnopqrstuvwxyz")), (2, f"{passage}\n" + " ".join(f"two{c}" for c in "abcdefghijklmnopqrstuvwxyz"))]
    rows += [(3, f"{other}\n{more} left"), (4, f"{other}\n{more} right"), (5, "a short line of six words\nfive"), (6, "a short line of six words\nsix")]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["text"] == t.replace(passage + "\n", "") for i, t in rows)
    assert [out[i]["n_dropped"] for i, _ in rows] == [1, 1, 0, 0, 0, 0]


@pytest.mark.parametrize("wrapper", ["<article class='review'>{}</article>", "<div class='comments-open'><article>{}</article></div>", "<div class='search-page'>{}</div>", "<div class='ad-free'>{}</div>", "<form id=aspnetForm>{}</form>"])
def test_marked_wrappers_keep_their_article(wrapper):
    first, second = ("plain words of the article " * 12).strip(), ("and more of them without links " * 9).strip()
    inner = f"<p>{first}</p><div class='sidebar'><p>Most read today</p></div><p>{second}</p><section id='comments'><p>{'what a reader has to say ' * 10}</p></section>"
    page = f"<html><body><nav><a href='/'>Home</a></nav>{wrapper.format(inner)}<footer>Imprint</footer></body></html>"
    assert html_text.main_text(page) == f"{first}\n\n{second}"
    hidden = f"<div style='display:none'>{inner}</div><p>short</p>"
    assert html_text.main_text(hidden) == "short"


def test_long_texts_that_share_many_lines(spark):
    def text(name, lines):
        return [f"{name} line {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]} of one text alone with words enough to be long" for i in range(lines)]

    shared = text("shared", 60)
    first, second = text("first", 900), text("second", 900)
    mixed = [x for i, x in enumerate(first) for x in ([x, shared[i // 15]] if i % 15 == 0 else [x])]
    rows = [(1, "\n".join(mixed), "own"), (2, "\n".join(second + shared), "own"), (3, None, "own"), (4, "", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    assert out[1]["text"] == "\n".join(first) and out[1]["n_lines"] == 960 and out[1]["n_dropped"] == 60
    assert out[2]["text"] == "\n".join(second) and out[2]["n_dropped"] == 60
    assert (out[3]["text"], out[3]["n_lines"], out[4]["text"], out[4]["n_lines"]) == (None, 0, "", 1)


def text_of(n, name="word"):
    return " ".join(f"{name}{i}" for i in range(n))


LAYOUTS = [
    ("<div id=content><h1>Head line</h1><p>{0}</p></div><aside><article><a href=x>Teaser link</a></article></aside>", "Head line|{0}"),
    ("<div id=content><h1>Head line</h1><p>{0}</p></div><div class=related><article><a href=x>Teaser</a></article><article><p>Second teaser text</p></article></div>", "Head line|{0}"),
    ("<article><h1>Title</h1><p>{1}</p></article><div><p>{0}</p></div>", "Title|{1}|{0}"),
    ("<article><h1>Title</h1><p>{0}</p></article><div><p>{1}</p></div>", "Title|{0}"),
    ("<main><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><div class=byline>By Ann</div><p>{0}</p></main>", "Let x=2 hold.|By Ann|{0}"),
    ("<nav><a href=/>Home</a></nav><div><h1>Head</h1><p>{0}</p><p>The end.</p></div><ul><li><a href=1>more one</a></li><li><a href=2>two</a></li></ul><div>Most read</div><ul><li><a href=3>x y</a></li></ul>", "Head|{0}|The end."),
    ("<form id=aspnetForm><main><p>{0}</p></main></form>", "{0}"),
    ("<div class=sidebar><main><p>{0}</p></main><p>{1}</p></div>", "{0}"),
]


@pytest.mark.parametrize("page,expected", LAYOUTS)
def test_page_layouts(page, expected):
    long, short = text_of(200), text_of(30, "brief")
    assert html_text.main_text(f"<html><body>{page.format(long, short)}</body></html>") == expected.format(long, short).replace("|", "\n\n")


def test_deep_and_empty_pages(spark):
    assert html_text.main_text("<div>" * 30000 + text_of(40)) == text_of(40)
    none = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_text.extract(none).collect() == [] and html_text.extract(none).columns == ["page_id", "text"]
    one = spark.createDataFrame([(1, f"<p>{text_of(40)}", "clash")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(one).collect()] == [(1, text_of(40))]
