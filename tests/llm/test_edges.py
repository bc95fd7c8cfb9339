"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

from tessellar.llm import lm_score, packing, secrets, toxicity, url_filter
from tessellar.llm.decontaminate import contamination, drop_contaminated
from tessellar.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_dedup
from tessellar.llm.line_dedup import line_dedup
from tessellar.llm.minhash import drop_near_copies, near_duplicates
from tessellar.llm.substring_dedup import substring_dedup
from tessellar.llm.workspace import Workspace

#: Names that the operators use inside.
CLASHING = "row batch digest cls slot signature token spans items score part kept first keys rank line lines key id n"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000)) + "y" * 200_000
ROWS = [(1, None), (None, "a b c d e f"), (2, ""), (3, LONG), (4, "A b c"), (4, "A b c"), (5, "a B c"), (None, None), (6, "\n\n"), (7, "😀 é\x00z")]


def tricky(spark, rows=ROWS):
    names = CLASHING.split()
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


def empty(spark):
    return tricky(spark).limit(0)


RUNS = {
    "exact": lambda s, d, w: exact_dedup(d, DigestIndex(s, w.path("index"), 2), w),
    "exact stage": lambda s, d, w: drop_exact_copies(d, DigestIndex(s, w.path("index"), 2), w),
    "packing": lambda s, d, w: packing.pack(d, w),
    "contamination": lambda s, d, w: contamination(d, s.createDataFrame([(1, "a b c"), (None, "d"), (2, None)], "item_id long, text string"), w),
    "contamination, no items": lambda s, d, w: drop_contaminated(d, s.createDataFrame([], "item_id long, text string"), w),
    "substring": lambda s, d, w: substring_dedup(d, w),
    "near": lambda s, d, w: near_duplicates(d, w),
    "near stage": lambda s, d, w: drop_near_copies(d, w),
    "lines": lambda s, d, w: line_dedup(d, w),
    "secrets": lambda s, d, w: secrets.scan_secrets(d, secrets.BlobLedger(s, w.path("ledger")), w, bits=1 << 16),
    "toxicity": lambda s, d, w: toxicity.with_scores(
        d, toxicity.train_on(d, s.createDataFrame([(4, 0), (5, 1), (3, None), (None, 1)], "doc_id long, toxic int"))
    ),
    "toxicity, no labels": lambda s, d, w: toxicity.drop_toxic(d, s.createDataFrame([], "doc_id long, toxic int")),
    "lm": lambda s, d, w: lm_score.lm_scores(d, w),
}
SAME_ROWS = set(RUNS) - {"exact stage", "near stage", "packing", "contamination, no items"}


@pytest.mark.parametrize("name", RUNS)
def test_tricky_rows(spark, name):
    got = RUNS[name](spark, tricky(spark), Workspace(spark, "edge")).collect()
    if name in SAME_ROWS:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, empty(spark), Workspace(spark, "edge")).count() == 0


def test_exact_ties(spark):
    ws = Workspace(spark, "edge")
    rows = exact_dedup(tricky(spark), DigestIndex(spark, ws.path("index"), 2), ws).collect()
    same = [r for r in rows if r.doc_id in (4, 5)]
    assert [(r.keep_id, r.group_size) for r in same] == [(5, 3)] * 3 and sum(r.kept for r in same) == 1
    void = [r for r in rows if r.doc_id in (1, 2) or (r.doc_id is None and r.group_size == 3)]
    assert {(r.doc_id, r.kept) for r in void} == {(1, False), (2, True), (None, False)}


def test_exact_stage_keeps_columns_and_one_of_repeated_rows(spark):
    ws = Workspace(spark, "edge")
    rows = drop_exact_copies(tricky(spark, [(4, "x"), (4, "x"), (3, "X"), (None, "y")]), DigestIndex(spark, ws.path("index"), 2), ws)
    assert rows.columns == tricky(spark).columns
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == [(4, "x"), (None, "y")]


def test_near_cases(spark):
    rows = {(r.doc_id, r.n_shingles): r for r in near_duplicates(tricky(spark), Workspace(spark, "edge")).collect()}
    assert rows[(1, 0)].component_id == 1 and rows[(2, 0)].kept and rows[(6, 0)].kept
    assert rows[(5, 1)].component_id == 4 and not rows[(5, 1)].kept
    assert rows[(None, 2)].component_id is None and rows[(None, 2)].kept


def test_substring_repeated_ids_keep_their_words(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = substring_dedup(tricky(spark, [(1, text), (1, text), (2, text), (None, text)]), Workspace(spark, "edge")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 0), ("1", 0), ("2", 20), ("None", 20)]


def test_long_text_is_read_whole(spark):
    rows = {r.doc_id: r for r in substring_dedup(tricky(spark), Workspace(spark, "edge")).collect() if r.doc_id}
    assert rows[3].n_words == len(LONG.split())
    packed = packing.pack(tricky(spark), Workspace(spark, "edge")).where("doc_id = 3").toPandas()
    assert packed.length.sum() == packed.doc_tokens.iloc[0] > 100_000


def test_empty_text_scores(spark):
    rows = lm_score.lm_scores(tricky(spark), Workspace(spark, "edge")).toPandas()
    void = rows[rows.doc_id == 2].iloc[0]
    assert void.n_tokens == 1 and void.score < 0 and void.base_score < 0


def test_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (2, "", "h")], "page_id long, url string, host string")
    rows = url_filter.judge(pages, model).collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [("", "", None)] * 3
    assert url_filter.judge(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        url_filter.train(url_filter.labelled_urls(spark).limit(0))


def test_shortest_texts_have_scores():
    model = toxicity.train(
        toxicity.np.array([0, 1]), toxicity.np.array([1, 1]), ["good", "bad"], toxicity.np.array([0.0, 1.0]), toxicity.np.ones(2)
    )
    for texts in ([""], ["a"], ["", ""], ["ab"], ["bad"]):
        assert model.score(texts).tolist() == [model.score(["bad good words go on here", t])[1] for t in texts]
