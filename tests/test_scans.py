"""Block scans against the step-by-step folds, heavy-hitter summaries against exact sums."""

import collections
import random

from pyspark.sql import functions as F

from fabrichealth.operators import folds, scans, sketches


def scores(n=700, seed=2):
    rnd = random.Random(seed)
    rows = []
    for node in range(4):
        for seq in range(n):
            quiet = (seq // 60 + node) % 3 == 0
            raw = 0.0 if quiet or node == 3 and seq > 5 else rnd.choice([0.0, 0.1, 0.6, 0.6, rnd.random()])
            rows.append((node, seq + 17 * node, raw, not quiet and rnd.random() < 0.6))
    return [r for r in rows if r[0] != 2 or r[1] % 7]  # a history with gaps


def test_scans_equal_the_folds(spark):
    rows = scores()
    df = spark.createDataFrame(rows, "node_id long, window_seq long, raw double, signal boolean").repartition(5)
    want, carry = {}, {}
    for node in range(4):
        s, raw = folds.Smoothed(), 0.0
        for _, seq, value, signal in (r for r in rows if r[0] == node):
            effective = s.update(value)
            want[node, seq] = (value, s.mean, s.peak, effective)
            raw = value if signal else max(0.9 * raw, value)
            carry[node, seq] = raw
    for block in (1, 16, 64, 100_000):
        got = {(r.node_id, r.window_seq): (r.raw, r.ewma, r.peak, r.effective) for r in scans.smoothed(df, block=block).collect()}
        assert got.keys() == want.keys()
        assert max(abs(a - b) for k in want for a, b in zip(want[k], got[k])) < 1e-12
        got = {(r.node_id, r.window_seq): r.raw for r in scans.carried(df.withColumnRenamed("raw", "fresh"), block=block).collect()}
        assert got.keys() == carry.keys() and max(abs(carry[k] - got[k]) for k in carry) < 1e-12
    plan = scans.smoothed(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scans.smoothed(df.limit(0)).count() == 0 == scans.carried(df.limit(0).withColumnRenamed("raw", "fresh")).count()


def test_one_long_history_is_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("node_id"), F.col("id").alias("window_seq"), (F.abs(F.hash("id")) % 1000 / 1000.0).alias("raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this little history would fit in one task
    try:
        tasks = scans.smoothed(df).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 200_000


def heavy(spark):
    rnd = random.Random(11)
    rows = [(rnd.randrange(2), min(int(rnd.paretovariate(0.8)), 3000), rnd.randrange(1, 50)) for _ in range(30_000)]
    exact = collections.Counter()
    for key, item, weight in rows:
        exact[key, item] += weight
    return spark.createDataFrame(rows, "node_id long, qp long, w long").repartition(6), exact


def test_space_saving_bounds_and_recall(spark):
    df, exact = heavy(spark)
    parts = sketches.summaries(df, ["node_id"], "qp", F.col("w"))
    summary = sketches.merged(parts, ["node_id"], "qp").collect()
    total = collections.Counter()
    for (key, _), weight in exact.items():
        total[key] += weight
    counted = collections.Counter(r.node_id for r in summary)
    assert counted == {0: 64, 1: 64}
    for r in summary:
        true = exact[r.node_id, r.qp]
        assert r["count"] - r.error <= true <= r["count"] and r.error <= total[r.node_id] / 64
    for key in (0, 1):
        best = sorted((i for k, i in exact if k == key), key=lambda i: -exact[key, i])[:8]
        found = [r.qp for r in sketches.space_saving(df, ["node_id"], "qp", F.col("w")).filter(f"node_id = {key}").collect()]
        assert len(set(best) & set(found)) >= 7
        floor = next(r.least for r in summary if r.node_id == key)
        assert all(weight <= floor for (k, i), weight in exact.items() if k == key and i not in {r.qp for r in summary if r.node_id == k})


def test_summaries_merge_in_any_order(spark, monkeypatch):
    df, exact = heavy(spark)
    parts = sketches.summaries(df, ["node_id"], "qp", F.col("w")).cache()
    once = sketches.merged(parts, ["node_id"], "qp")
    rows = parts.collect()
    back = spark.createDataFrame(rows[::-1], parts.schema)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sketches.merged(back, ["node_id"], "qp").collect()))
    halves = [sketches.merged(sketches.summaries(df.filter(F.pmod(F.hash("qp", "w"), F.lit(2)) == k), ["node_id"], "qp", F.col("w")), ["node_id"], "qp") for k in (0, 1)]
    for r in sketches.merged(halves[0].unionByName(halves[1]), ["node_id"], "qp").collect():
        assert r["count"] - r.error <= exact[r.node_id, r.qp] <= r["count"]
    few = df.filter("qp < 40")
    small = sketches.space_saving(few, ["node_id"], "qp", F.col("w"), top=100).collect()
    assert {(r.node_id, r.qp): r.weight for r in small} == {k: w for k, w in exact.items() if k[1] < 40} and all(r.error == 0 for r in small)


def test_verified_hitters_are_exact_with_more_items_than_counters(spark):
    rnd = random.Random(8)
    rows = [(0, rnd.randrange(97), rnd.randrange(1, 50)) for _ in range(3000)]  # near equals: no counter tells them apart
    rows += [(1, min(int(rnd.expovariate(0.08)), 96), 100) for _ in range(3000)] + [(None, 5, 3), (2, 7, 0), (2, 3, 0)] + [(3, 99 - k, 0) for k in range(97)]
    df = spark.createDataFrame(rows, "node_id long, qp long, w long").repartition(3)
    want = {}
    for node, qp, w in rows:
        want.setdefault(node, {}).setdefault(qp, 0)
        want[node][qp] += w
    top = sorted(((n, q, w, 0, k) for n, own in want.items() for k, (q, w) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:8], 1)), key=str)
    assert sorted(map(tuple, sketches.verified_hitters(df, ["node_id"], "qp", F.col("w")).collect()), key=str) == top
