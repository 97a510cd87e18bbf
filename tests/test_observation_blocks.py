"""A part's state is read and written by blocks of entries, not by items."""

import random

from ferrule.streaming import observation
from pyspark.sql import Row
from tests.test_streams import observe, plain, put, told


class Store:
    """A handle whose states are dictionaries that count their calls."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getValueState(self, name, *_):
        return State(self, self.held.setdefault(name, {}))

    getMapState = getValueState


class State:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def getValue(self, key):
        self.store.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.rows[key] = value

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.rows.clear()


def run(store, batch):
    worker = observation.Observations("user", None)
    worker.init(store)
    rows = iter([Row("user", "part", "arm", "item", "score")(7, 0, arm, item, score) for _, arm, item, score in batch])
    return {(r["user"], r["arm"]): (r["seen"], round(r["total"], 6), r["best"], r["best_item"], r["known"], r["drift"]) for r in worker.handleInputRows((7, 0), rows, None)}


def test_calls_to_the_store_are_made_by_blocks():
    draw, store = random.Random(5), Store()
    items = [k * 1024 - 10**6 for k in range(2000)]
    batches = [[(7, draw.choice("abc"), draw.choice(items), float(draw.randrange(50))) for _ in range(3000)] for _ in range(3)]
    for k in range(3):
        store.calls = 0
        out = run(store, batches[k])
        assert out == plain(batches[: k + 1])
        assert store.calls < 150  # 3,000 rows
    blocks = store.held["blocks"]
    assert len(blocks) > 8 and max(len(v[0]) for v in blocks.values()) < 8 * 3 * observation.BLOCK_ENTRIES
    store.calls = 0
    run(store, batches[0][:5])
    assert store.calls <= 2 + 2 * 5 and run(Store(), batches[0][:5]) == plain([batches[0][:5]])


def test_forgotten_blocks_leave_the_tallies():
    store = Store()
    batch = [(7, "a", k, 1.0) for k in range(1000)]
    run(store, batch)
    worker = observation.Observations("user", None)
    worker.init(store)
    assert not list(worker.handleExpiredTimer((7, 0), None, None)) and not store.held["blocks"]
    assert run(store, batch[:10]) == {(7, "a"): (1010, 1010.0, 1.0, 0, 0, 0)}


def test_nan_equals_itself_and_is_the_best():
    nan, store = float("nan"), Store()
    batch = [(7, "a", 1, 5.0), (7, "a", 2, nan), (7, "b", 2, nan)]
    assert run(store, batch)[7, "a"][3:] == (2, 0, 0) and run(store, batch)[7, "b"][3:] == (2, 1, 0)


def test_a_large_case_over_batches(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    draw, batches = random.Random(6), []
    for _ in range(3):
        batches.append([(u, draw.choice("ab"), i := draw.randrange(900 if u else 20), float(i % 11) + (draw.random() < 0.02)) for u in (0, 1) for _ in range(600)])
        put(spark, source, batches[-1])
    assert told(observe(spark, source, path, checkpoint, spread=1)) == plain(batches)


def test_arms_of_a_case_cost_no_calls_of_their_own():
    store = Store()
    batch = [(7, f"arm {k % 5}", k % 40, float(k % 40)) for k in range(200)]
    for k in (1, 2):
        store.calls = 0
        assert run(store, batch) == plain([batch] * k)
        assert store.calls == 2
