"""Keyed streaming operators with event-time timers and bounded state, on Spark's arbitrary-state API and RocksDB.

Every operator keeps rows until the watermark has passed them, then works them off in event-time order, so its result
depends neither on how rows were dealt to batches nor on restarts. What is kept per key is bounded: by a number of
entries with least-recently-used eviction, by an age, or by the lateness of the watermark. Rows whose key is null are
markers of time (see ``jobs.end_of_data``): they move the watermark and are dropped.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from fabrichealth.config import Thresholds
from fabrichealth.operators.folds import FOLD_COLUMNS, Verdict


def empty_window(node_id: int, window_seq: int) -> dict:
    """The figures of a window without events."""
    zero = {name: 0 for name in FOLD_COLUMNS}
    return {**zero, "node_id": node_id, "window_seq": window_seq, "score": 0.0, "has_link_signal": False, "has_traffic": False, "throughput": 1, "estimated_p99": 0.0, "fusion": 0.0}


#: Rows of a chunk of waiting rows, and rows that are sorted at a time before they are cut into chunks.
CHUNK, SORTED = 4096, 65_536


class Timed(StatefulProcessor):
    """Keeps the rows of a key by event time; ``due`` gets them in order once the watermark has passed them.

    Waiting rows are kept in chunks sorted by time, each under its first and last time, so the state is asked once a
    chunk and not once a row. Chunks are merged as their times come up: only those that overlap are open at once.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "low long, high long, no long", "names string, rows string")

    def _keep(self, names: list[str], rows: list[list]) -> None:
        """Rows with their time first, in order of time, as one more chunk."""
        low, high, no = rows[0][0], rows[-1][0], 0
        while self.waiting.containsKey((low, high, no)):
            no += 1
        self.waiting.updateValue((low, high, no), (json.dumps(names), json.dumps(rows)))

    def _spill(self, names: list[str], rows: list[list]) -> None:
        rows.sort(key=lambda r: r[0])
        for at in range(0, len(rows), CHUNK):
            self._keep(names, rows[at : at + CHUNK])

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            return
        names, held, first = None, [], None
        for row in rows:
            if names is None:
                names = [n for n in row.__fields__ if n not in ("event_time", "event_us")]
                places = [row.__fields__.index(n) for n in ("event_us", *names)]
            held.append([row[k] for k in places])
            if first is None or held[-1][0] < first:
                first = held[-1][0]
            if len(held) >= SORTED:
                self._spill(names, held)
                held = []
        if held:
            self._spill(names, held)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def passed(self, watermark_ms: int):
        """Takes what is not later than the watermark, in order of time, as (time, rows), and has the rest wait for it."""
        limit, heap, nexts = watermark_ms * 1000, [], []
        chunks = sorted(tuple(k) for k in self.waiting.keys())
        ready = [k for k in chunks if k[0] <= limit]
        nexts += [k[0] for k in chunks[len(ready) : len(ready) + 1]]
        opened = 0
        while heap or opened < len(ready):
            while opened < len(ready) and (not heap or ready[opened][0] <= heap[0][0]):
                names, rows = map(json.loads, self.waiting.getValue(ready[opened]))
                self.waiting.removeKey(ready[opened])
                heapq.heappush(heap, (rows[0][0], opened, 0, names, rows))
                opened += 1
            at, own = heap[0][0], []
            if at > limit:
                break
            while heap and heap[0][0] == at:
                _, chunk, k, names, rows = heapq.heappop(heap)
                while k < len(rows) and rows[k][0] == at:
                    own.append(dict(zip(names, rows[k][1:])))
                    k += 1
                if k < len(rows):
                    heapq.heappush(heap, (rows[k][0], chunk, k, names, rows))
            yield at, own
        for at, _, k, names, rows in heap:
            self._keep(names, rows[k:])
            nexts.append(at)
        if nexts:
            self.handle.registerTimer(-(-min(nexts) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.due(key, timerValues.getCurrentWatermarkInMs())

    def due(self, key, watermark_ms: int):
        raise NotImplementedError

    def close(self) -> None:
        pass


class Verdicts(StatefulProcessor):
    """The verdict of each window of a node when the watermark passes its end, whether or not the window had events.

    A window without a row is evaluated as an empty one, by a timer, so a silent node decays and recovers. With
    ``idle_windows`` a node that has been healthy and silent for so many windows is forgotten, until it sends again.
    """

    def __init__(self, t: Thresholds, order: tuple[str, ...], length_us: int, origin_us: int = 0, start: int | None = None, idle_windows: int | None = None):
        self.t, self.order, self.length, self.origin, self.start, self.idle_windows = t, order, length_us, origin_us, start, idle_windows

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "seq long", "row string")
        self.place = handle.getValueState("place", "next long, silent long, state string, weights string")

    def _end_ms(self, seq: int) -> int:
        return -(-(self.origin + (seq + 1) * self.length) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            return
        place = self.place.get() if self.place.exists() else None
        weights, first = (place[3] if place else None), None
        for row in rows:
            w = {k: v for k, v in row.asDict().items() if v is not None}
            w.pop("window_end", None)
            weights = w.pop("_weights", weights)
            seq = w["window_seq"]
            if place and place[0] is not None and seq < place[0]:
                continue  # evaluated before: Spark has dropped later ones by the watermark and counted them
            self.windows.updateValue((seq,), (json.dumps(w),))
            first = seq if first is None else min(first, seq)
        now = place[0] if place else None
        if first is not None:
            begin = first if now is None and self.start is None else self.start if now is None else now
            self.place.update((now, place[1] if place else 0, place[2] if place else None, weights))
            self.handle.registerTimer(self._end_ms(begin))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.place.exists():
            return
        watermark, (now, silent, state, weights) = timerValues.getCurrentWatermarkInMs(), self.place.get()
        held = sorted(k[0] for k in self.windows.keys())
        if now is None:
            if not held:
                return
            now = held[0] if self.start is None else min(self.start, held[0])
        step = Verdict(self.t, json.loads(weights) if weights else None, self.order)
        if state:
            step.load(json.loads(state))
        rest = set(held)
        while self._end_ms(now) <= watermark:
            if now in rest:
                w, silent = empty_window(key[0], now) | json.loads(self.windows.getValue((now,))[0]), 0
                self.windows.removeKey((now,))
                rest.discard(now)
            else:
                w, silent = empty_window(key[0], now), silent + 1
            out = step.update(w)
            yield Row(node_id=key[0], window_seq=now, **out)
            now += 1
            if self.idle_windows and silent >= self.idle_windows and out["state"] == "HEALTHY" and out["effective"] < 0.01:
                if not rest:
                    self.place.clear()
                    return
                now, silent, step = min(rest), 0, Verdict(self.t, step.weights, self.order)
        self.place.update((now, silent, json.dumps(step.dump()), weights))
        self.handle.registerTimer(self._end_ms(now))

    def close(self) -> None:
        pass


class BoundedMap(Timed):
    """A map of at most ``capacity`` entries for each key: the least recently written goes first, all go after an age.

    Rows with ``put`` write their value under ``item``; the others look theirs up. A value older than ``fresh_us`` is
    found but stale, and after ``evict_us`` it is gone. What capacity and age evict is reported too.
    """

    def __init__(self, capacity: int, fresh_us: int | None = None, evict_us: int | None = None):
        self.capacity, self.fresh_us, self.evict_us = capacity, fresh_us, evict_us

    def init(self, handle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "item long", "value long, written long, turn long")

    def due(self, key, watermark_ms: int):
        from collections import OrderedDict

        held = OrderedDict(sorted(((k[0], tuple(v)) for k, v in self.entries.iterator()), key=lambda x: x[1][2]))
        before, turn = dict(held), max((v[2] for v in held.values()), default=0)

        def expire(at: int):
            while self.evict_us is not None and held and at - next(iter(held.values()))[1] > self.evict_us:
                item, (value, written, _) = held.popitem(last=False)
                yield Row(node_id=key[0], event_us=written + self.evict_us, event_id=None, item=item, value=value, age_us=self.evict_us, outcome="expired")

        for at, rows in self.passed(watermark_ms):
            for row in sorted(rows, key=lambda r: r["event_id"]):
                yield from expire(at)
                item, known = row["item"], held.get(row["item"])
                if row["put"]:
                    if known is None and len(held) >= self.capacity:
                        old, (value, written, _) = held.popitem(last=False)
                        yield Row(node_id=key[0], event_us=at, event_id=row["event_id"], item=old, value=value, age_us=at - written, outcome="evicted")
                    turn += 1
                    held.pop(item, None)
                    held[item] = (row["value"], at, turn)
                else:
                    outcome = "missing" if known is None else "stale" if self.fresh_us is not None and at - known[1] > self.fresh_us else "found"
                    yield Row(node_id=key[0], event_us=at, event_id=row["event_id"], item=item, value=known and known[0], age_us=known and at - known[1], outcome=outcome)
        yield from expire(watermark_ms * 1000)
        for item in before.keys() - held.keys():
            self.entries.removeKey((item,))
        for item, v in held.items():
            if before.get(item) != v:
                self.entries.updateValue((item,), v)
        if self.evict_us is not None and held:
            self.handle.registerTimer((next(iter(held.values()))[1] + self.evict_us) // 1000 + 1)


#: What a bounded map gives.
BOUNDED_SCHEMA = "node_id long, event_us long, event_id long, item long, value long, age_us long, outcome string"


class AsOf(Timed):
    """The latest right row at or before each left row of the same keys, not older than ``max_age_us``.

    Both sides wait for the watermark; right rows are dropped once no left row to come can reach them.
    """

    def __init__(self, keys: tuple[str, ...], max_age_us: int):
        self.keys, self.max_age = keys, max_age_us

    def init(self, handle) -> None:
        super().init(handle)
        self.latest = handle.getValueState("latest", "at long, id long")

    def due(self, key, watermark_ms: int):
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        for at, rows in self.passed(watermark_ms):
            right = [r["event_id"] for r in rows if r["side"] == "right"]
            if right:
                latest = (at, max(right))
            for row in rows:
                if row["side"] == "left":
                    near = latest is not None and at - latest[0] <= self.max_age
                    yield Row(**dict(zip(self.keys, key)), event_id=row["event_id"], event_us=at, matched_id=latest[1] if near else None, matched_us=latest[0] if near else None)
        if latest is not None and watermark_ms * 1000 - latest[0] > self.max_age:
            self.latest.clear()
        elif latest is not None:
            self.latest.update(latest)
            self.handle.registerTimer((latest[0] + self.max_age) // 1000 + 1)


class Groups(Timed):
    """Notifications of alert groups by timers: ``alerting.Notifier`` fed in event time."""

    def __init__(self, keys: tuple[str, ...], make):
        self.keys, self.make = keys, make

    def init(self, handle) -> None:
        super().init(handle)
        self.group = handle.getValueState("group", "state string")

    def due(self, key, watermark_ms: int):
        named = dict(zip(self.keys, key))
        notifier = self.make(named)
        if self.group.exists():
            notifier.load(json.loads(self.group.get()[0]))
        for at, _ in self.passed(watermark_ms):
            for tick, kind in notifier.advance(at):
                yield Row(**named, at_us=tick, kind=kind)
            notifier.fire(at)
        for tick, kind in notifier.advance(watermark_ms * 1000 + 1):
            yield Row(**named, at_us=tick, kind=kind)
        if notifier.tick is None:
            self.group.clear()
        else:
            self.group.update((json.dumps(notifier.dump()),))
            self.handle.registerTimer(-(-notifier.tick // 1000))
