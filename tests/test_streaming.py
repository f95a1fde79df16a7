from stemma.sources.store import BlobStore
from stemma.streaming.incremental import append_entries, arriving_entries, changes_by_window, fill_store


def test_arriving_manifests(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.c4m").write_text("-rw-r--r-- 2024-01-01T00:10:00Z 5 x -\n-rw-r--r-- 2024-01-01T00:20:00Z 6 y -\n")
    (inbox / "bad.c4m").write_text("nonsense\n")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: append_entries(arriving_entries(spark, str(inbox)), out, state).awaitTermination(120)
    run()
    (inbox / "b.c4m").write_text("-rw-r--r-- 2024-01-01T03:00:00Z 7 z -\n")
    run()
    run()
    assert sorted((r.manifest_id, r.path) for r in spark.read.parquet(out).collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    q = changes_by_window(arriving_entries(spark, str(inbox))).writeStream.format("memory").queryName("by_window").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.files, r.bytes) for r in spark.sql("select * from by_window").collect()) == [(1, 7), (2, 11)]


def test_arriving_contents(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1").write_bytes(b"one")
    (inbox / "2").write_bytes(b"one")
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    for _ in range(2):
        fill_store(spark, str(inbox), s, str(tmp_path / "state")).awaitTermination(120)
    assert s.digests().count() == 1


def test_old_times_in_later_batches_count(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    got = {}

    def keep(df, _):
        got.update({str(r.window.start): (r.files, r.bytes) for r in df.collect()})

    # newest and a future time first, then times of months before, one in a window that has been counted
    for i, text in enumerate(("- 2022-08-01T00:10:00Z 5 x -\n- 2099-01-01T00:00:00Z 1 f -\n- 2020-09-01T03:00:00Z 2 w -\n", "- 2020-09-01T03:10:00Z 7 y -\n- 2021-01-01T00:10:00Z 8 z -\n", "- 2021-01-01T00:20:00Z 9 z -\n")):
        (inbox / f"m{i}.c4m").write_text(text)
        changes_by_window(arriving_entries(spark, str(inbox))).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
    assert got == {"2022-08-01 00:00:00": (1, 5), "2099-01-01 00:00:00": (1, 1), "2020-09-01 03:00:00": (2, 9), "2021-01-01 00:00:00": (2, 17)}


def test_bad_files_are_recorded(spark, tmp_path):
    from stemma.streaming.incremental import append_manifests

    inbox, table, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    inbox.mkdir()
    (inbox / "good.c4m").write_text("- - 1 a -\n")
    (inbox / "broken.c4m").write_text("- - 1 a -\n- - 2 b -\nnonsense\n")
    for name in ("late", "later"):
        for q in append_manifests(spark, str(inbox), table, bad, str(tmp_path / "state")):
            q.awaitTermination(120)
        (inbox / f"{name}.c4m").write_text("@directive\n")
    assert [(r.manifest_id, r.path) for r in spark.read.parquet(table).collect()] == [("good", "a")]
    assert sorted((r.manifest_id, r.message[:7]) for r in spark.read.parquet(bad).collect()) == [("broken", "line 3:"), ("late", "line 1:")]
