"""The exactly-once table and the observation loop, with crashes in all the places where one hurts."""

import glob
import os
import random
import signal
import subprocess
import sys
import time
from collections import defaultdict

import pytest
from ferrule.sources import stores
from ferrule.streaming import committed, observation, replay

SCHEMA = "user long, arm string, item long, score double"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put(spark, source, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    time.sleep(0.05)  # files are read in order of their times


def observe(spark, source, path, checkpoint, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = committed.written(observation.observed(stream, "user", "item", "score", arm="arm", **more), path, checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return committed.committed(spark, path)


def plain(batches):
    scored, arms = {}, defaultdict(lambda: [0, 0.0, None, None, 0, 0])
    for batch in batches:
        for user, arm, item, score in sorted((r for r in batch if r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[3], r[1])):
            known, seen = scored.get((user, item), (score, set()))
            scored[user, item] = known, seen
            own = arms[user, arm]
            own[5] += known != score
            if arm in seen:
                continue
            own[4] += len(seen) > 0
            seen.add(arm)
            own[0], own[1] = own[0] + 1, own[1] + known
            if own[2] is None or (known, -item) > (own[2], -own[3]):
                own[2], own[3] = known, item
    return {k: (v[0], round(v[1], 6), *v[2:]) for k, v in arms.items()}


def told(states):
    out = observation.current(states, "user", by_arm=True).collect()
    return {(r["user"], r["arm"]): (r["seen"], round(r["total"], 6), r["best"], r["best_item"], r["known"], r["drift"]) for r in out}


def test_observations_count_once_over_batches(spark, tmp_path):
    draw = random.Random(3)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    batches = []
    for k in range(3):
        batch = [(draw.randrange(4), draw.choice("abc"), i := draw.randrange(30), float(i * 7 % 13) + (draw.random() < 0.05)) for _ in range(80)]
        batch += [(1, "a", None, 1.0), (1, "a", 5, None)]
        batches.append(batch)
        put(spark, source, batch)
        states = observe(spark, source, path, checkpoint, spread=1 + 2 * (k < 0))
        assert told(states) == plain(batches)
    assert sum(v[5] for v in told(states).values()) > 0  # replays that drifted are told
    put(spark, source, batches[0])
    again = told(observe(spark, source, path, checkpoint, spread=1))
    assert {k: v[:5] for k, v in again.items()} == {k: v[:5] for k, v in plain(batches).items()}


def test_a_hot_case_is_shared_by_parts(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [(7, "a", k, float(k % 10)) for k in range(200)]
    put(spark, source, rows)
    put(spark, source, rows)
    states = observe(spark, source, path, checkpoint, spread=5)
    assert states.select("part").distinct().count() == 5
    assert told(states) == plain([rows, rows]) == {(7, "a"): (200, 900.0, 9.0, 9, 0, 0)}


def test_a_case_without_news_forgets_its_items(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put(spark, source, [(1, "a", 1, 2.0)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = committed.written(observation.observed(stream, "user", "item", "score", arm="arm", seconds=1, spread=1), path, checkpoint).trigger(processingTime="500 milliseconds").start()
    try:
        for k in range(60):
            if k == 12 or (k > 12 and k % 8 == 0):
                put(spark, source, [(1, "a", 1, 2.0)])
            time.sleep(0.5)
            assert q.exception() is None
            if os.path.exists(f"{path}/log/1.json") and told(committed.committed(spark, path)).get((1, "a"), (0,))[0] >= 2:
                break
    finally:
        q.stop()
    assert told(committed.committed(spark, path))[1, "a"][0] >= 2


RUN = """
import sys; from pyspark.sql import SparkSession; from tests.test_streams import observe_slowly
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
observe_slowly(spark, *sys.argv[1:])
"""


def observe_slowly(spark, source, path, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = committed.written(observation.observed(stream, "user", "item", "score", arm="arm", spread=1), path, checkpoint).trigger(processingTime="3 seconds").start()
    q.awaitTermination()


def test_killed_between_batches(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    draw = random.Random(4)
    batches = [[(draw.randrange(3), draw.choice("ab"), i := draw.randrange(20), float(i % 7)) for _ in range(40)] for _ in range(5)]
    for b in batches:
        put(spark, source, b)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run = subprocess.Popen([sys.executable, "-c", RUN, source, path, checkpoint], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        until = time.time() + 90
        while not os.path.exists(f"{path}/log/1.json") and time.time() < until:
            time.sleep(0.05)
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    assert 2 <= len(glob.glob(f"{path}/log/*.json")) < 5
    states = observe(spark, source, path, checkpoint, spread=1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert len(glob.glob(f"{path}/log/*.json")) == 5
    assert told(states) == plain(batches)


def test_a_batch_repeated_after_its_commit_adds_nothing(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(2):
        put(spark, source, [(k, "a", 10 * k + i, 1.0) for i in range(10)])
        replay.resumed(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint, "item").awaitTermination()
    files = sorted(os.listdir(f"{path}/data"))
    last = max(os.listdir(f"{checkpoint}/commits"), key=lambda n: (n.isdigit(), int(n) if n.isdigit() else 0))
    for name in glob.glob(f"{checkpoint}/commits/*{last}*") + glob.glob(f"{checkpoint}/commits/.{last}*"):  # as if the driver had died before Spark's own commit
        os.unlink(name)
    put(spark, source, [(9, "a", 5, 9.0), (9, "a", 50, 9.0)])
    replay.resumed(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint, "item").awaitTermination()
    rows = committed.committed(spark, path).collect()
    assert sorted(r["item"] for r in rows) == [*range(20), 50]
    assert set(files) <= set(os.listdir(f"{path}/data")) and committed.vacuum(spark, path) == 0


def test_files_of_a_batch_that_died_are_never_read(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put(spark, source, [(1, "a", 1, 1.0)])
    replay.resumed(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint, "item").awaitTermination()
    committed.BatchWriter(path).write(iter(spark.createDataFrame([(2, "b", 2, 2.0)], SCHEMA).toArrow().to_batches()))
    assert [r["item"] for r in committed.committed(spark, path).collect()] == [1]
    assert committed.vacuum(spark, path) == 1 and committed.vacuum(spark, path) == 0


def test_a_batch_reads_nothing_of_the_table(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put(spark, source, [(1, "a", k, 1.0) for k in range(5)])
    replay.resumed(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint, "item").awaitTermination()
    kept = {}
    for f in glob.glob(f"{path}/data/*.parquet"):  # unreadable while the next batch runs
        kept[f] = open(f, "rb").read()
        with open(f, "wb") as out:
            out.write(b"gone")
    put(spark, source, [(1, "a", k, 1.0) for k in range(3, 8)])
    replay.resumed(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint, "item").awaitTermination()
    for f, content in kept.items():
        with open(f, "wb") as out:
            out.write(content)
    assert sorted(r["item"] for r in committed.committed(spark, path).collect()) == list(range(8))


def test_a_table_has_one_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, "a", 1, 1.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    replay.resumed(stream, path, str(tmp_path / "cp"), "item").awaitTermination()
    with pytest.raises(Exception, match="fed by stream"):
        replay.resumed(stream, path, str(tmp_path / "other"), "item").awaitTermination()


def test_a_lock_outlived_by_its_lease(spark, tmp_path):
    place = str(tmp_path / "table")
    dead = stores.SingleWriter(spark, place, lease=1.0)
    dead.__enter__()
    with pytest.raises(RuntimeError, match="held"):
        stores.SingleWriter(spark, place, lease=1.0).__enter__()
    time.sleep(1.5)
    with stores.SingleWriter(spark, place, lease=1.0) as taken:
        with pytest.raises(RuntimeError, match="lost"):
            dead.renew()
        dead.__exit__()  # doesn't take the lock of another
        time.sleep(0.7)
        taken.renew()
        time.sleep(0.7)
        with pytest.raises(RuntimeError, match="held"):
            stores.SingleWriter(spark, place, lease=1.0).__enter__()
    stores.SingleWriter(spark, place).__enter__().__exit__()
