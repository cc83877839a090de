"""Streams: imports that are restarted, what holds now as state, windowed counts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.operators import importing, ingest, records, store, versions
from lorekeep.sources import vault
from lorekeep.streaming import increment
from lorekeep.streaming import store as streams

VERSION = "scope string, key string, created_at timestamp, id string, value string"
DAY = datetime(2024, 1, 1)


def test_streamed_import_equals_one_run_and_restarts(spark, tmp_path):
    notes, root = tmp_path / "vault", str(tmp_path / "streamed")
    (notes / "Projects" / "p").mkdir(parents=True)
    at = F.lit("2024-01-01").cast("timestamp")
    said = "Some knowledge that is long enough to be kept as a chunk of its own. "

    def add(*names):
        for n in names:
            (notes / "Projects" / "p" / f"{n}.md").write_text(f"---\ntype: pref\nkey: tone\nvalue: {n}\n---\n{said}{n}\n" if n.startswith("pref") else f"# {n}\n\n{said}{n}\n\nremember: the name of {n}\n")

    def run():
        streams.import_notes(vault.stream(spark, str(notes), files_a_batch=2), root, "v", str(tmp_path / "ck"), at=at).start().awaitTermination()

    add("one", "pref1", "two")
    run()
    first = store.last(spark, root)
    assert first == 2
    run()  # nothing came
    assert store.last(spark, root) == first
    add("pref2", "three")
    run()
    # A micro-batch that is run again, as after a failure before its end was noted, adds nothing.
    again = importing.run(spark, root, "stream-0000000002", vault.scan(spark, str(notes)).select("rel_path", "text"), "v", at)
    assert store.last(spark, root) == 3 and again.first()["events_created"] == 0

    whole = str(tmp_path / "whole")
    told = importing.run(spark, whole, "all", vault.scan(spark, str(notes)), "v", at).first()
    assert (told["documents_new"], told["events_created"], told["memories_created"], told["preferences_set"]) == (5, 8, 3, 2)
    for relation, schema in records.SCHEMAS.items():
        seen = [sorted(tuple(r) for r in store.read(spark, where, relation, schema).drop("seq", "tags").collect()) for where in (root, whole)]
        assert seen[0] == seen[1]
    now = versions.current(store.read(spark, root, "preference", records.SCHEMAS["preference"]), records.KEYS["preference"], records.VERSION_ORDER)
    assert [r["value"] for r in now.collect()] == ["pref2"]


def test_a_chunk_that_the_gate_refuses_stays_out_alone(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "x" * 30000), ("b.md", "remember: something that is fine"), ("c.md", "bad \x01 character in a text of forty characters")], "rel_path string, text string")
    told = importing.run(spark, str(tmp_path / "s"), "one", notes, "v").first()
    assert (told["documents_new"], told["chunks_planned"], told["chunks_ingested"], told["chunks_skipped_seen"], told["memories_created"]) == (3, 3, 1, 2, 1)


def test_lines_of_chunks_count_what_a_fence_hides():
    assert ingest.chunks("a\n```\nx\ny\n```\nb", least=1) == [(0, [], "a\nb", 1, 6)]


def stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_current_rows_as_state_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    every = []

    def write(*rows):
        every.extend(rows)
        spark.createDataFrame(list(rows), VERSION).write.mode("append").parquet(source)

    def run():
        keep = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
        streams.current(stream(spark, source, VERSION)).writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    at = lambda h: DAY + timedelta(hours=h)
    write(("s", "a", at(2), "2", "new"), ("s", "a", at(1), "1", "old"), ("s", "b", at(1), "3", "x"), ("t", "a", at(1), "9", "tie"))
    run()
    write(("s", "a", at(0), "0", "late"), ("s", "b", at(5), "4", "y"), ("t", "a", at(1), "91", "tie wins"))
    run()
    told = spark.read.parquet(out)
    last = versions.current(told.select("scope", "key", "created_at", "id", "value", "n"), ("scope", "key"), ("n",))
    batch = versions.current(spark.createDataFrame(every, VERSION), ("scope", "key"))
    show = lambda df: sorted((r["scope"], r["key"], r["id"], r["value"]) for r in df.collect())
    assert show(last) == show(batch) == [("s", "a", "2", "new"), ("s", "b", "4", "y"), ("t", "a", "91", "tie wins")]
    assert told.filter("scope = 's' AND key = 'a'").count() == 1  # the late version changed nothing


def test_keys_without_a_new_version_are_forgotten(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def write(*rows):
        spark.createDataFrame(list(rows), VERSION).write.mode("append").parquet(source)
        keep = lambda batch, n: batch.write.mode("append").parquet(out)
        streams.current(stream(spark, source, VERSION), "0 seconds", "10 days").writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    write(("s", "a", DAY, "1", "x"))
    write(("s", "b", DAY + timedelta(days=30), "2", "y"))
    write(("s", "b", DAY + timedelta(days=31), "3", "z"))
    assert sorted((r["key"], r["id"], r["active"]) for r in spark.read.parquet(out).collect()) == [("a", "1", False), ("a", "1", True), ("b", "2", True), ("b", "3", True)]


def test_windowed_counts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(DAY + timedelta(days=d), kind) for d, kind in ((0, "a"), (0, "a"), (0, "b"), (1, "a"), (9, "b"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(source)
    counted = increment.event_counts(stream(spark, source, "ts timestamp, event_type string"))
    run = lambda: counted.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(DAY, "a"), (DAY + timedelta(days=10), "b")], "ts timestamp, event_type string").write.mode("append").parquet(source)  # the first comes too late
    run()
    assert sorted((r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(out).collect()) == [(DAY, "a", 2), (DAY, "b", 1), (DAY + timedelta(days=1), "a", 1)]
