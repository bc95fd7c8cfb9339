"""Drafted labels on worked cases."""

from pyspark.sql import functions as F

from tessellar.operators import drafting


def test_evidence(spark):
    cases = {
        "A Title": False, "pool_size: 25": True, "// a comment that is long enough.": False, "ORDER BY avg_seconds DESC;": True, "Part One Two Three": False,
        "The mash rests at sixty degrees for an hour here.": True, "Section heading here": False,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select("t", drafting.reads_like_evidence(F.col("t"), F.lit("Doc > section  HEADING here")).alias("e")).collect()
    assert {r.t: r.e for r in got} == cases


def test_rank_prefers_the_rare_term(spark):
    spans = spark.createDataFrame([(1, 0, "$.training.epochs: 140"), (1, 1, "$.data.train_rows: 4820000"), (1, 2, "training training set"), (1, 3, "training loss")], "doc_id long, pos int, text string")
    asked = spark.createDataFrame([(7, 1, "How many training rows are there?")], "qid long, doc_id long, text string")
    assert drafting.rank_spans(spans, asked).where("rank = 1").first().pos == 1


def test_review_and_reanchor(spark):
    items = spark.createDataFrame([("a", "s", ["Old  fact"], False), ("b", "s", ["kept"], None)], "id string, source string, required_facts array<string>, verified_by_human boolean")
    verdicts = spark.createDataFrame([("a", True, "New fact")], "id string, verified boolean, fact string")
    got = drafting.review(items, verdicts)
    assert {r.id: (r.required_facts, r.verified_by_human) for r in got.collect()} == {"a": (["New fact"], True), "b": (["kept"], None)}
    chunks = spark.createDataFrame([("s", 0, "a new\nFACT here"), ("s", 1, "kept"), ("s", 2, "new fact")], "source string, position int, text string")
    assert {r.id: r.positions for r in drafting.reanchored(got, chunks).collect()} == {"a": [0, 2], "b": [1]}
