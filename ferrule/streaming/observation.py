"""The observation loop as a stateful stream: what each case has seen, by which arm, and at what physical cost.

Rows (case, arm, item, score) are observations revealed to an arm. An item of a
case is scored physically once, whichever arm asks first; when another arm asks, or
the same row is replayed in this or any later batch, the score known is used.
What a case has seen lies in the state store, in blocks of some hundred entries, of which a batch
reads and writes those of its own items: it costs in proportion to itself, and a call to the store
is made for a block, not for an item. Timers drop the entries of cases without news.

A case's items are dealt by hash to ``spread`` parts with a state each, so a
case that holds a third of all rows is shared by that many tasks. Each part's
state after a batch with news of it is a row of the output; ``current`` adds up the latest rows of a case's parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of an arm in a part of a case: observations, their sum, the best and its item, those whose score was known from another arm, replays with another score.
TALLY = "updates long, seen long, total double, best double, best_item long, known long, drift long"
#: Entries, each an item that an arm has seen with the score known, as arrays of numbers; an arm by its place in the tallies.
ENTRIES = {"items": "<i8", "scores": "<f8", "arms": "<i4"}
#: Entries of a part beside its tallies; beyond that they lie in blocks, of this many each at most on average.
BLOCK_ENTRIES = 256
#: Rows of a batch that are put in order together.
ROWS_TOGETHER = 10_000

_Entries = dict[int, tuple[float, list[int]]]


def _packed(entries: _Entries) -> tuple[bytes, ...]:
    flat = [(item, score, arm) for item, (score, arms) in entries.items() for arm in arms]
    return tuple(np.array(x, kind).tobytes() for x, kind in zip(zip(*flat) if flat else ((), (), ()), ENTRIES.values(), strict=True))


def _unpacked(packed: tuple) -> _Entries:
    entries: _Entries = {}
    for item, score, arm in zip(*(np.frombuffer(x, kind).tolist() for x, kind in zip(packed, ENTRIES.values(), strict=True)), strict=True):
        entries.setdefault(item, (score, []))[1].append(arm)
    return entries


def _block(item: int, blocks: int) -> int:
    """The block of an item among ``blocks``, a power of two: of twice as many, it is this one or the one that many further."""
    return (item * 0x9E3779B97F4A7C15 >> 32) % blocks


def _height(score: float) -> tuple[bool, float]:
    """Scores in SQL's order: NaN equals itself and is the greatest."""
    return (True, 0.0) if score != score else (False, score)


class Observations(StatefulProcessor):
    def __init__(self, case: str, seconds: int | None):
        self.case, self.seconds = case, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{name} binary" for name in ENTRIES)
        self.handle = handle
        self.part = handle.getValueState("part", f"tallies array<struct<arm string, {TALLY}>>, size long, blocks long, {kinds}")
        self.blocks = handle.getMapState("blocks", "block long", kinds)

    def _read(self, block: int) -> _Entries:
        there = self.blocks.getValue((block,))
        return _unpacked(there) if there else {}

    def _split(self, blocks: int, more: int, small: _Entries) -> None:
        """Deals the entries of ``blocks`` blocks, one after another, or of a part that had none so far, to ``more`` blocks."""
        for block in range(max(blocks, 1)):
            dealt: dict[int, _Entries] = {block: {}}
            for item, entry in (self._read(block) if blocks else small).items():
                dealt.setdefault(_block(item, more), {})[item] = entry
            for to, entries in dealt.items():
                self.blocks.updateValue((to,), _packed(entries))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told, size, blocks, *packed = self.part.get() or ([], 0, 0, b"", b"", b"")
        tallies: dict[str, list] = {arm: list(own) for arm, *own in told}
        place = {arm: k for k, arm in enumerate(tallies)}
        small, news = _unpacked(packed), set()
        while some := [(item, _height(score), arm, score) for *_, arm, item, score in islice(rows, ROWS_TOGETHER)]:
            held: dict[int, _Entries] = {} if blocks else {0: small}
            changed = set()
            # An item's least score among these rows is its first; arms in order of their names.
            for item, height, arm, score in sorted(some, key=lambda r: r[:3]):
                block = _block(item, blocks) if blocks else 0
                if block not in held:
                    held[block] = self._read(block)
                if arm not in tallies:
                    place[arm], tallies[arm] = len(tallies), [0, 0, 0.0, None, None, 0, 0]
                own, arms_place = tallies[arm], place[arm]
                news.add(arm)
                there = held[block].get(item)
                known, arms = there or held[block].setdefault(item, (score, []))
                own[6] += _height(known) != height
                if arms_place in arms:
                    continue
                arms.append(arms_place)
                changed.add(block)
                size += 1
                own[1] += 1
                own[2] += known
                own[5] += there is not None
                if own[3] is None or (_height(known), -item) > (_height(own[3]), -own[4]):
                    own[3], own[4] = known, item
            if blocks:
                for block in changed:
                    self.blocks.updateValue((block,), _packed(held[block]))
            if size > BLOCK_ENTRIES * max(blocks, 1):
                more = max(blocks, 1)
                while size > BLOCK_ENTRIES * more:
                    more *= 2
                self._split(blocks, more, small)
                blocks, small = more, {}
        for arm in news:
            tallies[arm][0] += 1
        self.part.update(([(arm, *own) for arm, own in tallies.items()], size, blocks, *_packed(small)))
        if self.seconds:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)
        out = Row(self.case, "part", "arm", *[f.split()[0] for f in TALLY.split(", ")])
        for arm in sorted(news):
            yield out(*key, arm, *tallies[arm])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Items are forgotten, tallies stay: an item that comes again after that counts again."""
        told = self.part.get()
        if told:
            self.part.update(([tuple(own) for own in told[0]], 0, 0, b"", b"", b""))
        self.blocks.clear()
        yield from ()

    def close(self) -> None:
        pass


def observed(stream: DataFrame, case: str, item: str, score: str, arm: str | None = None, seconds: int | None = None, spread: int = 8) -> DataFrame:
    """(case, part, arm, updates, seen, total, best, best_item, known, drift): the state of each arm in a part of a case after a batch with news of it.

    ``item`` is a long, ``score`` a double, ``arm`` a string (one arm, "", if there is none). ``seen``
    counts distinct items of the arm, ``known`` those of them that another
    arm had asked for before, ``drift`` replays whose score differs from the first. Equal scores: the smaller item is best. Rows with a null
    item or score are no observations. With ``seconds`` a case forgets its
    items after that long without news.

    The state store must be RocksDB; the session is set to it. With ``seconds`` the stream waits for its
    timers, so it needs a trigger by processing time; availableNow would not end.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = stream.schema[case].dataType.simpleString()
    rows = stream.where(F.col(item).isNotNull() & F.col(score).isNotNull())
    rows = rows.select(case, F.pmod(F.xxhash64(item), F.lit(spread)).cast("int").alias("part"), F.coalesce(F.col(arm).cast("string"), F.lit("")).alias("arm") if arm else F.lit("").alias("arm"), F.col(item).cast("long").alias("item"), F.col(score).cast("double").alias("score"))
    return rows.groupBy(case, "part").transformWithState(Observations(case, seconds), f"`{case}` {kind}, part int, arm string, {TALLY}", "Append", "ProcessingTime" if seconds else "None")


def current(states: DataFrame, case: str, by_arm: bool = False) -> DataFrame:
    """(case[, arm], seen, total, best, best_item, known, drift) from the rows that ``observed`` has put out: the latest of each part, added up."""
    value = F.struct("seen", "total", "best", "best_item", "known", "drift")
    last = states.groupBy(case, "part", "arm").agg(F.max_by(value, "updates").alias("s")).select(case, "arm", "s.*")
    best = F.max_by("best_item", F.struct("best", -F.col("best_item")))
    return last.groupBy(case, *["arm"] * by_arm).agg(F.sum("seen").alias("seen"), F.sum("total").alias("total"), F.max("best").alias("best"), best.alias("best_item"), F.sum("known").alias("known"), F.sum("drift").alias("drift"))
