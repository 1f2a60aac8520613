"""Streams with timers and bounded state: against batch, plain simulations, restarts and late rows."""

import collections
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.operators import alerting, folds, joins, rules
from fabrichealth.plans import base, stream_queries
from fabrichealth.plans.state_queries import rule_weights
from fabrichealth.plans.stream_queries import window_end
from fabrichealth.sources.adapter import EPOCH_US, WINDOW_US
from fabrichealth.streaming import jobs, stateful


def run(stream, out, checkpoint, **kw):
    query = jobs.to_tables(stream, out, checkpoint, **kw)
    query.awaitTermination(300)
    return query


def test_verdicts_by_timer_survive_a_restart(spark, sf_dir, tmp_path):
    """Only windows with events are sent; a silent node decays by timers, and the result equals the dense batch."""
    dense, weights = base.wins(spark, sf_dir).cache(), rule_weights(spark, sf_dir).cache()
    want = {(r.node_id, r.window_seq): r for r in folds.verdicts(rules.fold_input(dense, SCALED), SCALED, weights).collect()}
    last = max(seq for _, seq in want)
    sent = dense.filter("n_events > 0 and (node_id <> 2 or window_seq < 30)").withColumn("window_end", window_end(F.col("window_seq")))
    given = rules.fold_input(sent, SCALED, trend=False, keep=("window_end",)).cache()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stream = lambda: jobs.verdict_stream(jobs.replay(spark, source, given.schema), SCALED, weights, WINDOW_US, EPOCH_US, start=0)
    given.filter("window_seq < 50").coalesce(1).write.parquet(source)
    run(stream(), out, checkpoint)
    early = spark.read.parquet(f"{out}/*").count()
    given.filter("window_seq >= 50").coalesce(1).write.mode("append").parquet(source)
    jobs.end_of_data(spark, source, given.schema, "window_end", (last + 1) * WINDOW_US + EPOCH_US)
    batches = []
    run(stream(), out, checkpoint, handlers=[lambda rows, epoch: batches.append((epoch, rows.count()))])
    got = {(r.node_id, r.window_seq): r for r in spark.read.parquet(f"{out}/*").select(*next(iter(want.values())).asDict()).collect()}
    assert 0 < early < len(got) and sum(n for _, n in batches) == len(got) - early  # handlers see every batch once
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want if k[0] != 2 or k[1] < 30)
    silent = [got[2, seq] for seq in range(30, last + 1)]
    assert silent[-1].state == "HEALTHY" and silent[-1].effective < 0.05


def test_idle_nodes_are_forgotten(spark, tmp_path):
    seconds = 3_000_000
    zero = {name: 0 for name in folds.FOLD_COLUMNS}
    row = lambda node, seq: {**zero, "node_id": node, "window_seq": seq, "score": 0.9 if node == 1 else 0.0, "has_link_signal": True, "has_traffic": True, "throughput": 1, "estimated_p99": 0.0, "fusion": 0.0}
    data = [row(1, seq) for seq in (0, 1, 2, 3, 5000)] + [row(2, seq) for seq in range(0, 6000, 50)]
    kinds = {**{n: "long" for n in zero}, **{n: "double" for n in ("score", "estimated_p99", "fusion")}, **{n: "boolean" for n in ("has_link_signal", "has_traffic")}}
    df = spark.createDataFrame(data, ", ".join(f"{n} {kinds[n]}" for n in data[0])).withColumn("window_end", F.timestamp_micros((F.col("window_seq") + 1) * seconds))
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    jobs.end_of_data(spark, source, df.schema, "window_end", 6000 * seconds)
    stream = jobs.verdict_stream(jobs.replay(spark, source, df.schema), SCALED, length_us=seconds, idle_windows=100)
    run(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "out/*")).filter("node_id = 1").orderBy("window_seq").collect()
    assert {r.window_seq for r in rows} == {*range(104), *range(5000, 5101)}  # not the 4,900 windows in between
    assert [r.state for r in rows if r.window_seq in (3, 103)] == ["CRITICAL", "HEALTHY"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "node_id long, event_time timestamp, latency_ns long"
    for batch in ([(1, 0), (1, 100)], [(1, 101)], [(1, 3), (1, 102)]):  # Spark drops by the watermark of the batch before
        spark.createDataFrame([(n, s, 5) for n, s in batch], "node_id long, s long, latency_ns long").select("node_id", F.timestamp_seconds("s").alias("event_time"), "latency_ns").coalesce(1).write.mode("append").parquet(source)
    jobs.end_of_data(spark, source, schema, "event_time", 200_000_000)
    query = run(jobs.windowed(jobs.replay(spark, source, schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "out/*")).filter("node_id is not null").select(F.unix_timestamp("window.start").alias("s"), "n_events").collect()
    assert sorted(map(tuple, rows)) == [(0, 1), (99, 2), (102, 1)]
    assert jobs.late_rows(query) == 1


def plain_map(rows, capacity, fresh, evict):
    held, out = collections.OrderedDict(), []

    def expire(at):
        while held and at - next(iter(held.values()))[1] > evict:
            item, (value, written) = held.popitem(last=False)
            out.append((written + evict, None, item, value, evict, "expired"))

    for at, event_id, item, value, put in rows:
        expire(at)
        if put:
            if item not in held and len(held) == capacity:
                old, (v, written) = held.popitem(last=False)
                out.append((at, event_id, old, v, at - written, "evicted"))
            held.pop(item, None)
            held[item] = (value, at)
        elif item in held:
            v, written = held[item]
            out.append((at, event_id, item, v, at - written, "stale" if at - written > fresh else "found"))
        else:
            out.append((at, event_id, item, None, None, "missing"))
    expire(10**15)
    return collections.Counter(out)


def test_bounded_map_equals_a_plain_one(spark, tmp_path):
    rnd = random.Random(4)
    at, rows = 0, []
    for event_id in range(900):
        at += rnd.choice([0, 100, 1000, 1000, 40_000 if event_id % 100 == 0 else 500]) * 1000
        rows.append((at, event_id, rnd.randrange(12), event_id, rnd.random() < 0.5))
    rows.sort()
    want = plain_map(rows, 5, 3_000_000, 9_000_000)
    assert {k[-1] for k in want} == {"found", "stale", "missing", "evicted", "expired"}
    df = spark.createDataFrame([(1, *r) for r in rows], "node_id long, event_us long, event_id long, item long, value long, put boolean").withColumn("event_time", F.timestamp_micros("event_us"))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stream = lambda: jobs.bounded_lookups(jobs.replay(spark, source, df.schema), 5, 3_000_000, 9_000_000)
    middle = rows[450][0]
    df.filter(F.col("event_us") < middle).coalesce(1).write.parquet(source)
    run(stream(), out, checkpoint)
    df.filter(F.col("event_us") >= middle).coalesce(1).write.mode("append").parquet(source)
    jobs.end_of_data(spark, source, df.schema, "event_time", at + 20_000_000)
    run(stream(), out, checkpoint)
    got = spark.read.parquet(f"{out}/*").select("event_us", "event_id", "item", "value", "age_us", "outcome").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_streams_equal_batch_joins_and_notifications(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.randrange(3), rnd.randrange(5_000_000), i, rnd.choice(["left", "right"])) for i in range(400)]
    df = spark.createDataFrame(rows, "node_id long, event_us long, event_id long, side string").withColumn("event_time", F.timestamp_micros("event_us"))
    source = str(tmp_path / "in")
    for k in range(3):
        df.filter(F.floor(F.col("event_us") / 1_700_000) == k).coalesce(1).write.mode("append").parquet(source)
    jobs.end_of_data(spark, source, df.schema, "event_time", 6_000_000)
    given = jobs.replay(spark, source, df.schema)
    side = lambda name: given.filter((F.col("side") == name) | F.col("side").isNull())
    run(jobs.as_of_stream(side("left"), side("right"), ["node_id"], 20_000), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out/*")).select("node_id", "event_id", "matched_id").collect()
    right = df.filter("side = 'right'").groupBy("node_id", "event_us").agg(F.max("event_id").alias("matched_id")).withColumnRenamed("event_us", "at")
    batch = joins.as_of(df.filter("side = 'left'").select("node_id", "event_us", "event_id"), right, ["node_id"], "event_us", "at", ["matched_id"], max_age=20_000)
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select("node_id", "event_id", "matched_id").collect()))
    assert 20 < sum(r.matched_id is not None for r in got) < len(got) - 20

    alerts = spark.createDataFrame([(n, "A", s, (t + 1) * 15_000_000) for n in (1, 2) for s in ("DEGRADED", "CRITICAL") for t in range(58) if rnd.random() < 0.25 * n], "node_id long, alertname string, severity string, event_us long").withColumn("event_time", F.timestamp_micros("event_us"))
    source, until = str(tmp_path / "alerts"), 1_100_000_000
    for k in range(2):
        alerts.filter(F.floor(F.col("event_us") / 450_000_000) == k).coalesce(1).write.mode("append").parquet(source)
    jobs.end_of_data(spark, source, alerts.schema, "event_time", until)
    run(jobs.notification_stream(jobs.replay(spark, source, alerts.schema), repeat=120), str(tmp_path / "told"), str(tmp_path / "ck2"))
    got = spark.read.parquet(str(tmp_path / "told/*")).select(*alerting.GROUP, "at_us", "kind").collect()
    want = alerting.notifications(alerts, until, repeat=120).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.kind for r in want} == {"firing", "resolved"}


class FakeState(dict):
    """A map state and the handle that gives it, with its calls counted."""

    calls = 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, at_ms):  # noqa: N802
        self.timer = at_ms

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


def test_waiting_rows_are_kept_in_chunks_and_come_in_order():
    rnd, state = random.Random(4), FakeState()
    rows = [Row(node_id=1, event_us=rnd.randrange(40_000_000), event_time=None, event_id=k) for k in range(30_000)]
    timed = stateful.Timed()
    timed.init(state)
    for part in (rows[:14_000], rows[14_000:14_001], rows[14_001:]):  # batches that overlap in time
        list(timed.handleInputRows((1,), iter(part), None))
    got = []
    for watermark_ms in (0, 11_111, 11_111, 30_000, 40_000):
        for at, own in timed.passed(watermark_ms):
            assert at <= watermark_ms * 1000
            got += [(at, r["event_id"]) for r in own]
        rest = [r.event_us for r in rows if r.event_us > watermark_ms * 1000]
        assert len(got) == len(rows) - len(rest) and (not rest or state.timer == -(-min(rest) // 1000))
    assert [at for at, _ in got] == sorted(at for at, _ in got)
    assert sorted(got) == sorted((r.event_us, r.event_id) for r in rows)
    assert not state and state.calls < 150  # before: several for each row


def test_rows_of_a_replay_are_made_once(spark, tmp_path):
    """Every file of the replay reads the settled rows: they are not made again for each."""

    def made(batches):
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = spark.range(0, 90, 1, 1).mapInArrow(made, "id long").select("id", F.timestamp_micros("id").alias("event_time"))
    stream_queries.replayed(rows, "id", "event_time", 1000)
    assert len(list(tmp_path.iterdir())) == 1
