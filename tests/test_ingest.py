"""HTML extraction with the default selectors, manifest maintenance, files, and the streaming form."""

import random

import pytest
from pyspark.sql import functions as F

from newsatlas.operators import ingest
from newsatlas.sources import blocks, body_store, csv_records, html, schemas, sinks, tables
from newsatlas.streaming import manifest_store
from newsatlas.streaming.sync import read_manifest_log, sync_stream

ARTICLE = """<html><body><div id="content"><div class="column"><a>Bahia</a> <a> </a><a>Tema  dois</a></div>
<article><p class="section">Seção</p><p class="nitfSubtitle">Categoria</p><h1 class="documentFirstHeading big">Título &amp; mais</h1>
<div class="documentDescription">Linha
fina</div><div id="viewlet-above-content-body">Publicado em 01/02/2024 09h15 Atualizado em 02/02/2024 10h00</div>
<div id="content-core"><p>Um<p>Dois <b>três<script>x()</script><div class="visualClear">não</div><br>quatro</div></article></div></body></html>"""
LISTING = """<article class="tileItem other"><span class="subtitle">Operação</span><h2 class="tileHeadline"><a href="/n/1">Título um</a></h2>
<p class="tileBody"><span class="description">Resumo</span></p><span class="documentByLine">por X publicado 01/02/2024 09h15 Notícia</span>
<div class="keywords"><a>SP</a><a> </a><a>tema</a></div></article><article class="tileItem"><h2 class="tileHeadline"><a>Sem link</a></h2></article>"""


def pages(spark, cells):
    return spark.createDataFrame([(u, h) for u, h in cells.items()], "url string, html string")


def test_article_fields(spark):
    bad = {"no-title": ARTICLE.replace("documentFirstHeading", "x"), "no-body": ARTICLE.replace("content-core", "x"), "none": None}
    rows = {r["url"]: r for r in html.extract_articles(pages(spark, {"ok": ARTICLE, **bad})).collect()}
    ok = rows["ok"]
    assert (ok["section"], ok["category"], ok["title"], ok["subtitle"]) == ("Seção", "Categoria", "Título & mais", "Linha fina")
    assert (ok["published_at"], ok["updated_at"], ok["tags"]) == ("01/02/2024 09h15", "02/02/2024 10h00", ["Bahia", "Tema dois"])
    assert ok["body"] == "Um\n\nDois três\n\nquatro" and ok["error"] is None
    assert all(rows[k]["error"] and rows[k]["title"] is None for k in bad)
    text = html.article_text(html.extract_articles(pages(spark, {"ok": ARTICLE}))).first()["markdown_text"]
    assert text.split("\n\n") == [
        "Seção", "Categoria", "# Título & mais", "Linha fina", "Publicado em 01/02/2024 09h15", "Atualizado em 02/02/2024 10h00",
        "Tags: Bahia, Tema dois", "Um", "Dois três", "quatro",
    ]


def test_listing_fields(spark):
    df = spark.createDataFrame([(60, LISTING), (120, "<p>nothing")], "offset int, html string")
    first, second = html.extract_listing(df).orderBy("item_index").collect()
    assert (first["page_number"], first["item_index"], first["categoria"], first["titulo"], first["subtitulo"]) == (2, 1, "Operação", "Título um", "Resumo")
    assert (first["publicado_em"], first["data_publicacao"], first["hora_publicacao"], first["tipo_conteudo"]) == ("01/02/2024 09h15", "01/02/2024", "09h15", "Notícia")
    assert (first["tags"], first["total_tags"], first["link"]) == ("SP | tema", 2, "/n/1")
    assert second["link"] is None and second["publicado_em"] is None and second["tags"] == ""


def body(page, drop=()):
    return blocks.markdown(html.PageTree(page).root, drop)


def test_blocks_of_nested_lists_and_links():
    nested = "<ul><li>a <a href='/x'> link <b>here</b> </a>more<ul><li>n1<p>second<li>n2<ol start=3><li>c<li>d</ol></ul><li>b</ul><ul><li>other</ul>"
    assert body(nested) == "- a [link here](/x) more\n    - n1\n\n        second\n    - n2\n        3. c\n        4. d\n- b\n\n- other"
    assert body("see<a href=q> l<br>m</a>, <a>no link</a> <a href=z> </a>end") == "see [l m](q), no link end"
    assert body("<li>no list<p>after") == "no list\n\nafter"


def test_blocks_of_every_kind():
    page = "<h2>T <i>x</i></h2> lead <p>one<p>two<br>\n three<script>x()</script><blockquote><p>q1<p>q2<ul><li>z</ul></blockquote><pre>  a\n   b<br>c</pre><hr>tail"
    assert body(page, ("script",)) == "## T x\n\nlead\n\none\n\ntwo\nthree\n\n> q1\n\n> q2\n\n> - z\n\n```\n  a\n   b\nc\n```\n\ntail"
    table = "<table><thead><tr><th>A<th>B|C</thead><tr><td>1<td><a href=u>2</a><tr><td><p>p<p>q<tr></table><table><tr><td> </table>"
    assert body(table) == "| A | B\\|C |\n|---|---|\n| 1 | [2](u) |\n| p q |  |"


def test_blocks_of_odd_pages():
    assert body("") is None and body("<p> </p><ul><li></ul>") is None
    assert body("<div>" * 20000 + "x<p>y</p></b></ul>") == "x\n\ny"
    assert body("<ul><li>" * 300 + "deep").endswith("- deep")
    assert body("</td></li><td>cell<li>item<pre>open") == "cell\n\nitem\n\n```\nopen\n```"


def test_selector_backtracks_over_ancestors():
    page = html.PageTree('<div id="a"><div class="c"><p><div class="c"><a>x</a></div></div></div>').root
    assert len(html.find_all(page, "#a > div.c a")) == 1
    assert html.find_all(page, "#b a, p.none") == []


def test_sync_twice_is_sync_once(spark):
    listing = spark.createDataFrame([(0, LISTING)], "offset int, html string")
    articles = pages(spark, {"/n/1": ARTICLE})
    nothing = spark.createDataFrame([], schemas.MANIFEST)
    no_bodies = spark.createDataFrame([], "markdown_path string")
    once = ingest.sync(listing, articles, nothing, no_bodies, "d")
    row = once.first()
    assert (row["link"], row["status"], row["tags_extraidas"], once.count()) == ("/n/1", "ok", "Bahia | Tema dois", 1)
    twice = ingest.sync(listing, pages(spark, {}), once, once.select("markdown_path"), "d")
    assert twice.collect() == once.collect()
    lost = ingest.sync(listing, pages(spark, {}), once, no_bodies, "d").first()
    assert (lost["status"], lost["titulo_extraido"]) == ("erro", None)


def test_upsert_is_idempotent_and_missing_adds_up(spark):
    old = spark.createDataFrame([("a", "1", "ok"), ("b", "2", "erro")], "link string, markdown_path string, status string")
    new = spark.createDataFrame([("b", "3", "ok")], old.schema)
    merged = ingest.upsert(old, new)
    assert sorted(merged.collect()) == sorted(ingest.upsert(merged, new).collect())
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "link string, seq int")
    bodies = spark.createDataFrame([("1",)], "markdown_path string")
    left = [r["link"] for r in ingest.missing(index, merged, bodies).orderBy("seq").collect()]
    done = [r["link"] for r in ingest.finished(merged, bodies).collect()]
    assert left == ["b", "c"] and sorted(left + done) == ["a", "b", "c"]
    assert [r["link"] for r in ingest.pending(index, 2).collect()] == ["a", "b"]


def test_csv_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, str(tmp_path / "none"))
    (tmp_path / "bad.csv").write_text("url\nx\n")
    with pytest.raises(ValueError):
        tables.load_index(spark, str(tmp_path / "bad.csv"))
    assert tables.load_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "index.csv").write_text('﻿link,titulo,offset,extra\n"l1","a ""b"", c\nd",60,z\n', encoding="utf-8")
    row = tables.load_index(spark, str(tmp_path / "index.csv")).first()
    assert (row["link"], row["titulo"], row["offset"], row["tags"]) == ("l1", 'a "b", c\nd', 60, None)


def odd_csv(rows):
    draw = random.Random(2)
    cells = ["plain", "a,b", 'say ""x""', "two\nlines", "\n", "", '""', "é\n\n\nlong", " padded ", "x" * 300, "1\r\n2"]
    out = ["link,titulo,offset"]
    for i in range(rows):
        a, b = draw.choice(cells), draw.choice(cells)
        out.append(f'l{i},"{a}",{i}' if i % 3 else f'"l{i}","{b}\n{a}","{i}"')
        out += [""] * (i % 50 == 7)
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size,rows", [(64, 60), (700, 300), (1 << 20, 300)])
def test_csv_splits_give_the_rows_of_the_whole_file(spark, tmp_path, size, rows):
    (tmp_path / "t.csv").write_bytes(odd_csv(rows).encode())
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "t.csv"))
    expected = sorted(map(tuple, whole.collect()), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert (csv_records.lines(spark, str(tmp_path / "t.csv")).select("split").distinct().count() > 10) == (size < 1 << 20)
        assert sorted(map(tuple, csv_records.read(spark, str(tmp_path / "t.csv")).collect()), key=str) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_folder_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufefflink,n\n"x\ny",1\nz,', encoding="utf-8")
    (tmp_path / "b.csv").write_text('\ufefflink,n\nw,"2"\n\n', encoding="utf-8")
    assert sorted(map(tuple, csv_records.read(spark, str(tmp_path)).collect())) == [("w", "2"), ("x\ny", "1"), ("z", None)]
    (tmp_path / "c.csv").write_text("n,link\n1,v\n")
    with pytest.raises(Exception, match="another header"):
        csv_records.read(spark, str(tmp_path)).collect()


def test_bodies_are_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "um ç.md").write_text("# Título\n\nlinha", encoding="utf-8")
    path = str(tmp_path / "b" / "um ç.md")
    assert tables.read_bodies(spark, str(tmp_path / "b")).collect() == [(path, "# Título\n\nlinha")]
    assert [r[0] for r in tables.list_bodies(spark, str(tmp_path / "b")).collect()] == [path]
    manifest = spark.createDataFrame([("l", path, "ok"), ("m", "gone", "ok"), ("n", path, "erro")], "link string, markdown_path string, status string")
    bodies = tables.list_bodies(spark, str(tmp_path / "b"))
    assert [r["link"] for r in tables.usable_manifest(manifest, bodies).collect()] == ["l"]
    assert tables.missing_bodies(manifest, bodies).first()["missing"] == 1


def test_stream_extracts_each_page_once(spark, tmp_path):
    source, home = str(tmp_path / "pages"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("url string, html string").parquet(source)
        sync_stream(spark, stream, f"{home}/manifest", f"{home}/bodies", f"{home}/state", "d").awaitTermination()
        return sorted((r["link"], r["status"]) for r in read_manifest_log(spark, f"{home}/manifest").collect())

    pages(spark, {"/1": ARTICLE, "/2": "<p>"}).write.parquet(source)
    assert run() == [("/1", "ok"), ("/2", "erro")]
    assert run() == [("/1", "ok"), ("/2", "erro")]
    pages(spark, {"/1": "<p>", "/2": ARTICLE}).write.mode("append").parquet(source)
    assert run() == [("/1", "ok"), ("/2", "ok")]
    assert body_store.paths(spark, f"{home}/bodies").count() == 2


def test_packed_bodies_are_found_by_path(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = [(f"d/{i:04d} ç.md", f"# {i}\n\n" + "text " * (i % 40)) for i in range(600)]
    bodies = spark.createDataFrame(rows, body_store.BODY)
    body_store.append(bodies, folder, 0, file_bytes=4000)
    body_store.append(spark.createDataFrame([(rows[7][0], "new"), ("d/late.md", "late")], body_store.BODY), folder, 1)
    body_store.append(spark.createDataFrame([(rows[7][0], "newer"), ("d/late.md", None)], body_store.BODY), folder, 1)  # a replay
    now = dict(rows) | {rows[7][0]: "newer", "d/late.md": None}
    files = body_store.directory(spark, folder).collect()
    assert len(files) > 10 and sum(r["bodies"] for r in files) == 602
    assert dict(map(tuple, tables.read_bodies(spark, folder).collect())) == now
    assert {r[0] for r in tables.list_bodies(spark, folder).collect()} == set(now)
    wanted = spark.createDataFrame([(rows[7][0],), (rows[300][0],), ("none",), (None,), (rows[300][0],)], "markdown_path string")
    found = body_store.get(spark, folder, wanted)
    assert sorted(map(tuple, found.collect())) == [(rows[7][0], "newer"), rows[300]] and len(found.inputFiles()) <= 4
    many = spark.createDataFrame([(p,) for p, _ in rows[:400]], "markdown_path string")
    assert dict(map(tuple, body_store.get(spark, folder, many).collect())) == {p: now[p] for p, _ in rows[:400]}
    assert body_store.get(spark, folder, wanted.limit(0)).count() == 0
    body_store.compact(spark, folder, f"{folder}-one")
    assert dict(map(tuple, body_store.read(spark, f"{folder}-one").collect())) == now


def test_manifest_is_the_same_with_and_without_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest_store, "BUCKETS", 8)
    draw, logged = random.Random(9), {}

    def rows(batch):
        links = sorted({f"l{draw.randrange(60)}" for _ in range(5)})
        return spark.createDataFrame([(k, f"{batch}/{k}", draw.choice(["ok", "erro"])) + (None,) * 6 for k in links], schemas.MANIFEST)

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for batch in range(9):
        manifest_store.compact(spark, a, batch, least=3)
        new = rows(batch)
        for folder in (a, b):
            manifest_store.append(new.limit(1), folder, batch)  # a failed run, then its replay
            manifest_store.append(new, folder, batch)
        logged |= {r["link"]: r for r in new.collect()}
    at = manifest_store.pointer(spark, a)
    assert at.made == 2 and at.upto == 5 and manifest_store.pointer(spark, b).made == 0
    assert {r["batch"] for r in manifest_store.tail(spark, a, at).select("batch").collect()} == {6, 7, 8}
    for folder in (a, b):
        assert {r["link"]: r for r in manifest_store.read(spark, folder).collect()} == logged
    links = spark.createDataFrame([(k,) for k in ["l1", "l2", "none"]], "link string")
    done = [sorted(r[0] for r in manifest_store.finished(spark, f, links, 8).collect()) for f in (a, b)]
    own = [r[0] for r in links.select(manifest_store.bucket()).distinct().collect()]
    read = {f.split("bucket=")[1].split("/")[0] for f in manifest_store.base(spark, a, at, own).inputFiles()}
    assert read <= {str(x) for x in own} and done[0] == done[1]


def test_csv_export_packs_lists(spark, tmp_path):
    df = spark.createDataFrame([(" a ", ["x", "y"])], "t string, l array<string>")
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').select(F.col("t"), "l").first() == (" a ", '["x","y"]')


def test_a_broken_listing_page_is_one_error_row(spark):
    pages = spark.createDataFrame([(0, "<p><![foo[bar]]></p>"), (60, LISTING)], "offset int, html string")
    rows = html.extract_listing(pages).collect()
    assert [r["offset"] for r in rows if r["error"]] == [0]
    assert [r["link"] for r in rows if r["offset"] == 60 and not r["error"]]
    assert {r["offset"] for r in ingest.collect_listing(pages).collect()} == {60}


def test_absent_pages_are_error_rows(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "link string")
    pages = spark.createDataFrame([("a", ARTICLE), ("c", ARTICLE)], "url string, html string")
    rows = {r["link"]: r for r in ingest.fetch_articles(wanted, pages).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["error"] is None and rows["b"]["error"] == f"no '{html.ArticleRules().container}' in the page"
