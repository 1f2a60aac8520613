"""Log-bucket quantiles, heavy hitters and top lists, as mergeable grouped counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.02


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Signed bucket of a value: 0 for zero and what is not finite."""
    log_gamma = math.log((1 + alpha) / (1 - alpha))
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    index = F.floor(F.log(F.abs(value)) / log_gamma) + 1
    return F.when(finite & (value > 0), index).when(finite & (value < 0), -index)


def bucket_counts(rows: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """The sketch as rows: (keys, sign, bucket, n). Sketches merge by adding counts."""
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    sign = F.when(finite & (v > 0), 1).when(finite & (v < 0), -1).otherwise(0)
    log_gamma = math.log((1 + alpha) / (1 - alpha))
    index = F.when(sign != 0, F.floor(F.log(F.abs(v)) / log_gamma) + 1).otherwise(0).cast("int")
    return rows.filter(v.isNotNull()).groupBy(*keys, sign.alias("sign"), index.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], qs: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """(keys, n, one column per quantile): the upper edge of the bucket that holds the rank."""
    gamma = (1 + alpha) / (1 - alpha)
    order = W.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    total = F.sum("n").over(W.partitionBy(*keys))
    edge = F.col("sign") * F.pow(F.lit(gamma), F.col("bucket"))
    walked = counts.select(*keys, F.sum("n").over(order).alias("upto"), total.alias("total"), edge.alias("edge"), F.struct("sign", (F.col("sign") * F.col("bucket")).alias("b"), edge.alias("edge")).alias("place"))
    at = lambda q: F.floor(F.lit(q) * (F.col("total") - 1) + 0.5) + 1
    return walked.groupBy(*keys).agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= at(q), F.col("place")))["edge"].alias(name) for name, q in qs.items()])


def heavy_hitters(rows: DataFrame, keys: list[str], item: str, weight: Column, top: int = 8) -> DataFrame:
    """The ``top`` items of each key by summed weight, exactly; of equals the smaller item."""
    sums = rows.groupBy(*keys, item).agg(F.sum(weight).alias("weight"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("weight"), item))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= top)


#: Counters of a summary, and summaries that a task holds before it gives them on.
CAPACITY, HELD = 64, 4096


class SpaceSaving:
    """The heaviest items of a stream in ``capacity`` counters: a counter is never below its item's weight, and above it
    by its error at most; the least counter is handed to an item that has none."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.counters = capacity, {}

    def observe(self, item, weight: int) -> None:
        found = self.counters.get(item)
        if found is not None:
            found[0] += weight
        elif len(self.counters) < self.capacity:
            self.counters[item] = [weight, 0]
        else:
            least = min(self.counters, key=lambda x: (self.counters[x][0], x))
            count = self.counters.pop(least)[0]
            self.counters[item] = [count + weight, count]

    @property
    def least(self) -> int:
        """What an item without a counter can weigh at most."""
        return min((c for c, _ in self.counters.values()), default=0) if len(self.counters) >= self.capacity else 0


def summaries(rows: DataFrame, keys: list[str], item: str, weight: Column, capacity: int = CAPACITY) -> DataFrame:
    """(keys, item, count, error, least): each task's summaries, instead of a row for each key and item.

    A task holds ``HELD`` summaries at most and then gives them on: a key may have several, which merge like any.
    Null items and weights are left out; negative weights are refused.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, item]) + ", count long, error long, least long"

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, SpaceSaving] = {}
        names = [*keys, item, "count", "error", "least"]

        def given(kind):
            out = [(*key, i, count, error, s.least) for key, s in held.items() for i, (count, error) in s.counters.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*out), kind)], names)

        kind = None
        for batch in batches:
            kind = [batch.schema.field(n).type for n in [*keys, item]] + [pa.int64()] * 3
            for *key, i, w in zip(*(batch.column(n).to_pylist() for n in [*keys, item, "_w"])):
                if w < 0:
                    raise ValueError("a heavy-hitter weight is below 0")
                held.setdefault(tuple(key), SpaceSaving(capacity)).observe(i, w)
            if len(held) >= HELD:
                yield given(kind)
        if held:
            yield given(kind)

    asked = rows.select(*keys, item, weight.cast("long").alias("_w")).filter(F.col(item).isNotNull() & F.col("_w").isNotNull())
    return asked.mapInArrow(run, schema)


def merged(parts: DataFrame, keys: list[str], item: str, capacity: int = CAPACITY) -> DataFrame:
    """One summary per key from any number of them, in any order: (keys, item, count, error, least).

    An item that a summary has no counter for may weigh as much there as that summary's least counter.
    """
    # a full summary has exactly ``capacity`` rows of its least counter, others have 0; one pass over the parts, since
    # tasks that run again may meet their rows in another order and then make other summaries
    floored = parts.withColumn("_floor", (F.sum("least").over(W.partitionBy(*keys)) / capacity).cast("long"))
    kept = floored.groupBy(*keys, item).agg((F.sum(F.col("count") - F.col("least")) + F.max("_floor")).alias("count"), (F.sum(F.col("error") - F.col("least")) + F.max("_floor")).alias("error"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("count"), item))
    top = kept.withColumn("_rank", rank).filter(F.col("_rank") <= capacity)
    full = F.count("*").over(W.partitionBy(*keys)) >= capacity
    return top.withColumn("least", F.when(full, F.min("count").over(W.partitionBy(*keys))).otherwise(0)).drop("_rank")


def space_saving(rows: DataFrame, keys: list[str], item: str, weight: Column, top: int = 8, capacity: int = CAPACITY) -> DataFrame:
    """The ``top`` items of each key by their counters: (keys, item, weight, error, rank); of equals the smaller item."""
    summary = merged(summaries(rows, keys, item, weight, capacity), keys, item, capacity)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("count"), item))
    return summary.withColumn("rank", rank).filter(F.col("rank") <= top).select(*keys, item, F.col("count").alias("weight"), "error", "rank")


def verified_hitters(rows: DataFrame, keys: list[str], item: str, weight: Column, top: int = 8, capacity: int = CAPACITY) -> DataFrame:
    """The ``top`` items of each key by exact weight: (keys, item, weight, error, rank), error 0; of equals the smaller item.

    The summaries name the candidates, whose weights a second pass sums: items whose counter reaches the ``top``-th
    certain weight. Where an item without a counter may reach it too, all items of the key are summed.
    """
    own = W.partitionBy(*keys)
    certain = F.row_number().over(own.orderBy(F.desc(F.col("count") - F.col("error"))))
    bounded = merged(summaries(rows, keys, item, weight, capacity), keys, item, capacity).withColumn("_certain", certain)
    bounded = bounded.withColumn("_bar", F.coalesce(F.max(F.when(F.col("_certain") == top, F.col("count") - F.col("error"))).over(own), F.lit(0)))
    reached = F.collect_list(F.when(F.col("count") >= F.col("_bar"), F.col(item))).alias("_items")
    open_ = ((F.count("*") >= capacity) & F.max(F.col("least") >= F.col("_bar"))).alias("_open")
    named = bounded.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(reached, open_)
    asked = rows.select(*keys, item, weight.cast("long").alias("_w")).filter(F.col(item).isNotNull() & F.col("_w").isNotNull())
    same = [asked[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    found = asked.join(named, same).filter(F.col("_open") | F.array_contains("_items", F.col(item)))
    exact = heavy_hitters(found, keys, item, F.col("_w"), top)
    return exact.select(*keys, item, "weight", F.lit(0).cast("long").alias("error"), "rank")


def recent(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
