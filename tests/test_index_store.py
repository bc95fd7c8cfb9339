"""Written indexes follow their session's chunks; facts of any length are found."""

from tessellar.operators import evaluation, lexical


def test_index_is_rebuilt_where_chunks_changed(spark, tmp_path):
    store = lexical.IndexStore(spark, str(tmp_path / "index"))
    chunks = lambda rows: spark.createDataFrame(rows, "session_id string, chunk_id long, text string")
    terms = lambda index: {(r.session_id, r.term): r.df for r in index.terms.collect()}
    rows = [("a", 1, "one two"), ("a", 2, "two three"), ("b", 3, "one")]
    assert terms(store.index(chunks(rows))) == {("a", "one"): 1, ("a", "two"): 2, ("a", "three"): 1, ("b", "one"): 1}
    more = [*rows, ("b", 4, "four")]
    assert terms(store.index(chunks(more)))[("b", "four")] == 1
    # as many chunks as before, other texts: told by the caller
    edited = [*rows, ("b", 4, "five")]
    assert ("b", "five") not in terms(store.index(chunks(edited)))
    store.invalidate("b")
    assert terms(store.index(chunks(edited)))[("b", "five")] == 1


def test_facts_of_any_length(spark):
    facts = [(1, "x"), (2, "ab"), (3, "word pair"), (4, "a longer fact here"), (5, "nowhere"), (6, " "), (7, "rd")]
    docs = [(1, "An AB word  pair"), (2, "x a longer fact here"), (3, None), (4, "sword pairs")]
    found = evaluation.contained_facts(
        spark.createDataFrame(facts, "fact_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    )
    norm = lambda t: " ".join((t or "").lower().split())
    want = {(f, d) for f, t in facts for d, u in docs if norm(t) and norm(t) in norm(u)}
    assert {(r.fact_id, r.doc_id) for r in found.collect()} == want
