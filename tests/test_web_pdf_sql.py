"""Web candidates and guards, PDF lines, functions for SQL, and vectors without a model."""

import math

from pyspark.sql import functions as F

from tessellar.functions.embedding import hashed_embedding
from tessellar.functions.sql import register_all
from tessellar.operators import evaluation, gold
from tessellar.operators.occurrences import without_overlap
from tessellar.sources import pdf, web


def test_urls_in_prose(spark):
    text = "See https://en.wikipedia.org/wiki/ROUGE_(metric)). Also (http://a.com/x/), http://A.com/x#f 【0†L1〕 and https://b.org/?q=1."
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    found = web.candidates(rows, 5).orderBy("place").collect()
    assert [r.url for r in found] == ["https://en.wikipedia.org/wiki/ROUGE_(metric)", "http://a.com/x/", "https://b.org/?q=1"]
    assert web.candidates(rows, 2).count() == 2


def test_public_addresses():
    assert web.is_public(["8.8.8.8"]) and not web.is_public([])
    for bad in ("127.0.0.1", "10.0.0.1", "100.100.100.200", "169.254.169.254", "::1", "::ffff:10.0.0.1", "224.0.0.1"):
        assert not web.is_public(["8.8.8.8", bad])


def test_fetching_is_guarded(spark):
    pages = {"http://ok.com/": ("http://ok.com/", "text/html", b"x"), "http://hop.com/": ("http://local/", "text/html", b"x"), "http://big.com/": ("http://big.com/", "", b"x" * 99)}
    names = {"ok.com": ["8.8.8.8"], "hop.com": ["8.8.8.8"], "big.com": ["8.8.8.8"], "local": ["127.0.0.1"]}
    wanted = spark.createDataFrame([(u,) for u in [*pages, "http://local/", "ftp://x", "http://gone.com/"]], "url string")
    rows = web.fetch_pages(wanted, lambda u: pages[u], lambda h: names.get(h, []), most_bytes=50).collect()
    assert {r.url: r.status == "ok" for r in rows} == {u: u == "http://ok.com/" for u in [*pages, "http://local/", "ftp://x", "http://gone.com/"]}


def test_titles():
    assert web.title_of("<title>a  b</title><h1>c</h1>") == "a b"
    assert web.title_of("<nav><h1>menu</h1></nav><h1>x &amp; <b>y</b></h1>") == "x & y" and web.title_of("<p>none") == ""
    assert len(web.shortened("w " * 100)) <= 120


def test_pdf_headings(spark):
    body = [(1, p, 9, 10.0, "ordinary text of the body that is long enough.", False) for p in range(1, 7)]
    heads = [
        (1, 2, 0, 20.0, "Chapter One", False), (1, 2, 1, 14.0, "Section A", False), (1, 4, 0, 14.0, "Section B", False), (1, 5, 0, 20.0, "Chapter Two", False),
        (1, 1, 0, 20.0, "Running Header", True), (1, 3, 0, 20.0, "1234567", False), (1, 6, 0, 20.0, "Ends with a stop.", False),
    ] + [(1, p, 3, 16.0, "Acme Confidential", False) for p in range(1, 7)]
    lines = spark.createDataFrame(body + heads, "doc_id long, page int, pos int, size double, text string, in_margin boolean")
    got = {r.page: r.heading for r in pdf.page_headings(lines).collect()}
    assert got == {2: "Chapter One > Section A", 3: "Chapter One > Section A", 4: "Chapter One > Section B", 5: "Chapter Two", 6: "Chapter Two"}


def test_pages_merge(spark):
    typed = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id long, page int, text string")
    scanned = spark.createDataFrame([(1, 2, "B"), (1, 3, "C")], "doc_id long, page int, text string")
    assert sorted(map(tuple, pdf.merged_pages(typed, scanned).collect())) == [(1, 1, "a", "text"), (1, 2, "B", "ocr"), (1, 3, "C", "ocr")]
    rows = spark.createDataFrame([([1],), ([1, 2],), ([1, 2, 7],)], "p array<int>").select(pdf.pages_phrase("p").alias("t"))
    assert [r.t for r in rows.collect()] == ["1", "1 and 2", "1, 2 and 7"]


def test_sql_functions(spark):
    names = register_all(spark)
    assert names == ["ts_chunk_spans", "ts_fold", "ts_sentences", "ts_numeric_heavy", "ts_tokens", "ts_content_terms"]
    row = spark.sql("SELECT ts_chunk_spans('a b c d', 3, 0) s, ts_fold('ﬁx  it') f, ts_sentences('One. Two.') t, ts_numeric_heavy('12345678 90') n").first()
    assert [tuple(x) for x in row.s] == [(0, 1), (2, 3), (4, 5), (6, 7)] or row.s[0].start == 0
    assert (row.f, [tuple(x) for x in row.t], row.n) == ("fix it", [(0, 4), (5, 9)], True)


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([("cat sat cat",), ("",)], "t string").select(hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and sum(rows[1].v) == 0


def test_overlap_between_chunks(spark):
    rows = [("s", 0, 0, 10, "0123456789", [(2, 4), (8, 10)]), ("s", 1, 6, 16, "6789abcdef", [(2, 4), (3, 6)]), ("s", 3, None, None, "zz", [(0, 1)])]
    found = spark.createDataFrame(rows, "source string, position int, char_start int, char_end int, text string, spans array<struct<start:int,end:int>>")
    got = {r.position: [tuple(s) for s in r.spans] for r in without_overlap(found).collect()}
    assert got == {0: [(2, 4), (8, 10)], 1: [(3, 6)], 3: [(0, 1)]}


def test_ranking_metrics(spark):
    rank = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "qid long, id string, rank int")
    wanted = spark.createDataFrame([(1, c) for c in "abc"], "qid long, id string")
    row = evaluation.ranking_metrics(rank("xbycz"), wanted, 5).first()
    assert (round(row.recall, 4), row.precision, row.reciprocal_rank, row.hit) == (0.6667, 0.4, 0.5, 1)
    assert abs(evaluation.ranking_metrics(rank("cxya"), wanted, 4).first().ndcg - (1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 0.5)) < 1e-12
    assert evaluation.ranking_metrics(rank("aa"), wanted, 2).first().precision == 0.5


def test_multi_block(spark):
    rows = [(1, 0, "A", "alpha beta"), (1, 1, "b", "gamma delta"), (1, 2, "a", "alpha beta"), (2, 0, "x", "alpha")]
    got = gold.multi_block(spark.createDataFrame(rows, "doc_id long, pos int, answer string, text string")).collect()
    assert sorted((r.pos_a, r.pos_b) for r in got) == [(0, 1), (1, 2)]


def test_sql_tokens_are_those_of_the_columns(spark, sf):
    from tessellar.functions import sql
    from tessellar.functions.text import content_terms, tokens

    assert {"ts_tokens", "ts_content_terms"} <= set(sql.register_all(spark))
    extra = spark.createDataFrame([("the HTTPServer parse_json camelCase x 1,200.5 3abc",)], "text string")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(extra)
    both = rows.select(
        tokens(F.col("text")) != F.expr("ts_tokens(text)"), content_terms(F.col("text")) != F.expr("ts_content_terms(text)")
    ).toDF("a", "b")
    assert both.where("a OR b").count() == 0
