"""Commands on the notebook tables, and streams against their batch forms."""

from pyspark.sql import functions as F

from tessellar.operators import ledger
from tessellar.store import SCHEMAS, Store
from tessellar.streaming import streams


def sources(spark, rows):
    frame = spark.createDataFrame(rows, "session_id string, id string, name string, content_hash string")
    for f in spark.createDataFrame([], SCHEMAS["sources"]).schema:
        if f.name not in frame.columns:
            frame = frame.withColumn(f.name, F.lit(None).cast(f.dataType))
    return frame.withColumn("created_at", F.current_timestamp())


def chunks(spark, rows):
    frame = spark.createDataFrame(rows, "session_id string, source_id string, position int, text string, numeric_heavy boolean")
    for f in spark.createDataFrame([], SCHEMAS["chunks"]).schema:
        if f.name not in frame.columns:
            frame = frame.withColumn(f.name, F.lit(None).cast(f.dataType))
    return frame


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.ensure_default_session() == "default" == store.ensure_default_session("other")
    store.create_session("s1", "  ")
    store.rename_session("s1", "Physics")
    assert {(r.id, r.name) for r in store.list_sessions().collect()} == {("default", "Untitled session"), ("s1", "Physics")}

    new = sources(spark, [("s1", "a", "a.txt", "h1"), ("s1", "b", "copy.txt", "h1"), ("s1", "c", "c.txt", "h2"), ("default", "d", "a.txt", "h1")])
    cut = chunks(spark, [("s1", "a", 0, "xx", False), ("s1", "a", 1, "yyyy", True), ("s1", "b", 0, "zz", False), ("s1", "c", 0, "w", False), ("default", "d", 0, "v", False)])
    store.add_sources(new, cut)
    store.add_sources(new, cut)  # all known by now
    assert {r.id: (r.chunk_count, r.numeric_count) for r in store.read("sources").collect()} == {"a": (2, 1), "c": (1, 0), "d": (1, 0)}
    assert sorted(r.chunk_id for r in store.read("chunks").collect()) == [1, 2, 3, 4]
    assert {r.id for r in store.find_duplicates(new).collect()} == {"a", "c", "d"}
    row = store.stats("s1").first()
    assert (row.sources, row.chunks, row.numeric, row.numeric_pct, row.avg_chars, row.max_chars, row.size_splits) == (2, 3, 1, 33.3, 2, 4, None)
    assert store.stats("nobody").first().chunks == 0

    store.reindex("s1", "a", chunks(spark, [("s1", "a", 0, "new text", False)]))
    assert [(r.text, r.chunk_id) for r in store.read("chunks", "s1").where("source_id = 'a'").collect()] == [("new text", 5)]
    assert store.read("sources", "s1").where("id = 'a'").first().chunk_count == 1
    assert store.problems().count() == 0
    store.remove_source("s1", "c")
    assert [r.id for r in store.sources("s1").collect()] == ["a"]

    store.add_message("s1", "user", "hi")
    store.add_message("s1", "assistant", "hello", evidence='{"cost": {"prompt_tokens": 3}}')
    assert [(r.id, r.role) for r in store.read("messages", "s1").orderBy("id").collect()] == [(1, "user"), (2, "assistant")]
    usage = spark.createDataFrame([(1, "web", "gpt-4o", 1, 2, 3.0, None, "s1")], "id long, kind string, model string, prompt_tokens int, completion_tokens int, latency_ms double, created_at timestamp, session_id string")
    store.record_usage(usage)
    store.delete_session("s1")
    assert store.read("messages").count() == 0 and store.read("chunks", "s1").count() == 0
    assert [r.session_id for r in store.read("usage_events").collect()] == [None]
    assert {r.id for r in store.read("sessions").collect()} == {"default"} and store.read("chunks", "default").count() == 1


def test_price_lookup(spark):
    calls = spark.createDataFrame([("GPT-4o ", 10), ("x/gpt-4o-mini", 10), ("llama3.1", 10), ("other", 10), (None, 10)], "model string, t long")
    rows = ledger.with_price(calls, ledger.prices(spark)).withColumn("usd", ledger.cost_usd(F.col("t"), F.col("t"))).collect()
    assert {r.model: r.usd for r in rows} == {"GPT-4o ": 0.0002, "x/gpt-4o-mini": 0.000008, "llama3.1": 0.0, "other": None, None: None}


def split_events(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "events"))
    return rows, streams.events(spark, str(tmp_path / "events"), 1)


def test_stream_totals(spark, sf, tmp_path):
    rows, stream = split_events(spark, sf, tmp_path)
    got = streams.drained(streams.ledger_totals(stream), "totals", "complete", str(tmp_path / "c"))
    want = streams.ledger_totals(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_latency_equals_batch(spark, sf, tmp_path):
    rows, stream = split_events(spark, sf, tmp_path)
    got = streams.drained(streams.latency(stream, 50), "latency", "update", str(tmp_path / "c"))
    last = {r.event_type: tuple(r) for r in got.collect()}  # the table in memory is in order of batches
    want = ledger.latency_report(rows, "event_type", "value", [F.col("ts").desc(), F.col("event_id").desc()], 50)
    assert sorted(last.values()) == sorted(map(tuple, want.collect()))


def test_stream_of_files_without_repeats(spark, tmp_path):
    schema = "session_id string, path string, content binary"
    for k, rows in enumerate(([("s", "a", b"x"), ("s", "b", b"x")], [("s", "c", b"x"), ("t", "d", b"x"), ("s", "e", b"y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = streams.drained(streams.new_files(stream), "files", "append", str(tmp_path / "c")).collect()
    assert len(got) == 3 and {(r.session_id, bytes(r.content)) for r in got} == {("s", b"x"), ("t", b"x"), ("s", b"y")}


def test_chunk_ids_follow_sources_and_positions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ids = [f"s{i:03d}" for i in range(60)]
    store.add_sources(
        sources(spark, [("x", s, s, s) for s in ids]), chunks(spark, [("x", s, p, f"{s} {p}", False) for s in ids[::-1] for p in range(3, -1, -1)])
    )
    found = store.read("chunks").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in found] == list(range(1, 241))
    assert [(r.source_id, r.position) for r in found] == [(s, p) for s in ids for p in range(4)]
    assert not any((tmp_path / "store" / "_staged").iterdir())


def test_messages_hold_json(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add_message("x", "user", "what?", evidence={"cost": {"prompt_tokens": 3}})
    rows = spark.createDataFrame(
        [(2, "assistant", "é [1]", [(1, "a")], {"k": 1.5}, None, "x"), (3, "assistant", "no", None, None, None, "x")],
        "id long, role string, content string, citations array<struct<n: int, name: string>>, evidence map<string, double>, created_at timestamp, session_id string",
    )
    store.add_messages(rows)
    found = [(r.citations, r.evidence) for r in store.read("messages", "x").orderBy("id").collect()]
    assert found == [(None, '{"cost": {"prompt_tokens": 3}}'), ('[{"n":1,"name":"a"}]', '{"k":1.5}'), (None, None)]
