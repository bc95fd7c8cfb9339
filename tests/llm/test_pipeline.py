"""The pipeline: stages take effect, keep columns, and each is the operator it names."""

import brute
import corpus_pipeline
from tessellar.llm.workspace import Workspace


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ws, counts = docs.columns, Workspace(spark, "t"), [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if k < 4 else None
        docs = ws.write(stage(spark, docs, sf), f"s{k}")
        if k < 4:
            assert docs.columns == columns
            kept = {r.doc_id for r in docs.collect()}
            counts.append(len(kept))
        if name == "exact dedup":
            assert kept == {i for i, v in brute.exact(before).items() if v[2]}
        if name == "near dedup":
            assert kept == {i for i, v in brute.near(before).items() if v[2]}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert kept == {i for i, v in brute.contamination(before, items).items() if not v[4]}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    pieces = docs.toPandas()
    assert set(pieces.doc_id) == kept
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ws = Workspace(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.write(stage(spark, docs, sf), f"s{k}")
    parts = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert parts(corpus_pipeline.run(spark, sf)) == parts(docs)


NAMES = "lang source row key digest id no_id cls score items"
SCHEMA = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES.split())


def small_tables(spark, folder, rows, items=(), labels=()):
    """Tables for the stages, with columns named like those the operators use inside."""
    docs = spark.createDataFrame([(*r, *NAMES.split()) for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    folder = small_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0


def test_nulls_repeats_and_no_labels(spark, tmp_path):
    leaked = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (None, None), (None, "only one"), (3, "Same text"), (4, "same TEXT"), (4, "same TEXT"), (5, leaked)]
    folder = small_tables(spark, tmp_path, rows, [(1, leaked), (None, None), (2, "")], [(1, None, None), (None, 1, 1), (99, 0, 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = Workspace(spark, "t").write(stage(spark, docs, folder), f"e{k}")
        assert docs.columns == ["doc_id", "text", *NAMES.split()]
        assert [tuple(r)[2:] for r in docs.distinct().collect()][0] == tuple(NAMES.split())
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    by = lambda found: sorted(found, key=str)
    assert kept[0] == by(rows)
    assert kept[1] == kept[2] == by([(2, ""), (None, "only one"), (4, "same TEXT"), (5, leaked)])
    assert kept[3] == by([(2, ""), (None, "only one"), (4, "same TEXT")])
    pieces = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id for r in pieces.collect()), key=str) == by([2, None, 4])
