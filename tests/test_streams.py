"""The motif stream: order, late rows, state, restart; the resumable run."""

import random

import pytest
from brute import EVENTS
from pyspark.sql import functions as F

from chronomotif.operators import motifs
from chronomotif.streaming.motif_stream import motif_stream


@pytest.fixture(scope="module")
def streaming(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def run(session, source, motif, folder, **options):
    """Reads what is in ``source``, a file a batch; gives the query's progress."""
    stream = session.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source)
    query = motif_stream(stream, motif, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    return query.recentProgress


def write(session, rows, path, k):
    session.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(f"{path}/{k:02d}")


def test_stream_equals_batch_out_of_order_and_after_a_restart(streaming, tmp_path):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(7), rng.randrange(7), i // 2, "d" if rng.random() < 0.1 else "a") for g in (1, 2, 3) for i in range(60)]
    rows += rng.sample(rows, 5)  # repeated events count once
    shaken = sorted(rows, key=lambda r: r[4] + rng.random() * 4)  # up to four steps late
    source, folder = str(tmp_path / "in"), str(tmp_path)
    parts = [shaken[k : k + 50] for k in range(0, len(shaken), 50)]
    for k, part in enumerate(parts[:2]):
        write(streaming, part, source, k)
    run(streaming, f"{source}/*", "triangle", folder, delay="5 seconds", window=4)
    for k, part in enumerate(parts[2:], 2):
        write(streaming, part, source, k)
    write(streaming, [(9, 0, 0, 1, 500, "a")], source, 90)  # moves the watermark past all
    write(streaming, [(1, 99, 0, 1, 3, "a"), (2, 99, 1, 2, 4, "a"), (9, 1, 1, 2, 700, "a")], source, 91)  # two late rows
    progress = run(streaming, f"{source}/*", "triangle", folder, delay="5 seconds", window=4)
    got = sorted((r.graph_id, r.first_time, r.last_time) for r in streaming.read.parquet(f"{folder}/out").collect() if r.graph_id != 9)
    te = streaming.createDataFrame(rows, EVENTS)
    want = sorted((r.graph_id, r.t0, r.t2) for r in motifs.found(te, "triangle", window=4, mode="monomorphism").collect())
    assert got == want and len(want) > 5
    states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 2
    assert states[-1]["numRowsTotal"] <= 8  # graphs 1 to 3 left no state


def test_state_follows_the_window_not_the_log(streaming, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path)
    for k in range(4):
        write(streaming, [(1, 100 * k + i, i % 5, (i + 1) % 5, 50 * k + i // 2, "a") for i in range(100)], source, k)
    progress = run(streaming, f"{source}/*", "3-star", folder, window=2)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(totals) >= 4 and max(totals) < 250 and totals[-1] <= 40
    assert streaming.read.parquet(f"{folder}/out").where(F.col("last_time") - F.col("first_time") > 2).count() == 0


def test_run_ends_anywhere_and_answers_everything_once(spark, tmp_path):
    """Stopped after a batch was written, and inside one; started again; new and repeated questions later."""
    from chronomotif.sources import json_files
    from chronomotif.streaming import runs

    questions, folder, asked = str(tmp_path / "questions"), str(tmp_path / "run"), tmp_path / "asked"
    asked.mkdir()
    add = lambda rows: spark.createDataFrame(rows, runs.QUESTIONS).coalesce(1).write.mode("append").parquet(questions)
    for k in range(4):
        add([("sort_edge", 10 * k + i, f"q {k} {i}") for i in range(5)])

    def provider(prompts):
        if any(p.startswith("q 2") for p in prompts) and not (asked / "mended").exists():
            raise RuntimeError("no connection")
        for p in prompts:
            with open(asked / p.replace(" ", "-"), "a") as f:
                f.write("x")
        return [None if p.endswith("3") else f"Answer: {p}" for p in prompts]

    def stop(number):
        if number == 0:
            raise RuntimeError("stopped after a batch was written")

    with pytest.raises(Exception, match="stopped after"):
        runs.run(questions, folder, provider, spark, files_a_batch=1, committed=stop)
    assert runs.answered(spark, folder).count() == 5  # written, not committed
    with pytest.raises(Exception, match="no connection"):
        runs.run(questions, folder, provider, spark, files_a_batch=1)
    (asked / "mended").write_text("")
    done = runs.run(questions, folder, provider, spark, files_a_batch=1)
    key = lambda df: sorted((r.task, r.graph_id) for r in df.collect())
    assert key(done) == [("sort_edge", 10 * k + i) for k in range(4) for i in range(5)]
    add([("sort_edge", 0, "q 0 0"), ("sort_edge", 77, "q 7 7"), ("sort_edge", 77, "q 7 7"), ("what_edges", 0, "w 0")])
    done = runs.run(questions, folder, provider, spark)
    assert len(key(done)) == len(set(key(done))) == 22
    assert {p.name: len(p.read_text()) for p in asked.iterdir() if p.name != "mended"} == {r.replace(" ", "-"): 1 for r in [f"q {k} {i}" for k in range(4) for i in range(5)] + ["q 7 7", "w 0"]}
    rest = runs.left(spark.read.parquet(questions).distinct(), done)
    assert sorted(r.graph_id for r in rest.collect()) == [3, 13, 23, 33]
    for _ in range(2):
        json_files.append_log(done, str(tmp_path / "log"), key="first")
    assert spark.read.json(str(tmp_path / "log")).count() == 22


def test_many_state_questions(spark):
    """The index answers like ``edges_at``, for every time, also long after the last event and in a log with ties and deletes."""
    from chronomotif.operators import logs

    rng = random.Random(2)
    rows = [(g, i, rng.randrange(5), rng.randrange(5, 9), i // 3 * (3 if g == 2 else 1), rng.choice("aad")) for g in (1, 2) for i in range(80)]
    te = spark.createDataFrame(rows, EVENTS)
    times = [0, 1, 5, 13, 26, 27, 78, 79, 1_000_000]
    asked = spark.createDataFrame([(g, t, f"{g}/{t}") for g in (1, 2) for t in times], "graph_id bigint, at int, name string")
    got = sorted((r.name, r.u, r.v, r.t, r.op) for r in logs.alive_at(logs.alive_index(te), asked).collect())
    want = sorted((f"{r.graph_id}/{t}", r.u, r.v, r.t, r.op) for t in times for r in logs.edges_at(te, t).collect())
    assert got == want and got
    index = logs.alive_index(te).cache()
    assert index.count() < 64 * te.count() and index.groupBy("graph_id", "u", "v", "t", "level").count().agg(F.max("count")).first()[0] <= 4
