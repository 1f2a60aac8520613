"""Recursions over a node's history as block scans, without Python: a history of any length is spread over tasks.

A node's windows are cut into blocks. What a block does to the state that comes in is a small function, and such
functions compose: the smoothed mean is affine, the carried score is the larger of a line through zero and a
constant, the decaying peak is a few constants up to a bound and a line beyond. Blocks are summarised in parallel, a
node's summaries are scanned in order (one row per block), and each block is then walked from its own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.sources.store import settle

c, lit = F.col, F.lit
#: Windows of a block.
BLOCK = 1024


def _blocks(rows: DataFrame, values: list[str], block: int) -> DataFrame:
    """(node_id, block, rows): the rows of each block in order; at most ``block`` of them for distinct windows."""
    cut = rows.select("node_id", F.floor(c("window_seq") / block).alias("block"), F.struct("window_seq", *values).alias("_r"))
    return settle(cut.groupBy("node_id", "block").agg(F.sort_array(F.collect_list("_r")).alias("rows")), "blocks")


def _starts(blocks: DataFrame, summary: Column, first: Column, after) -> DataFrame:
    """(node_id, block, start): the state before each block; ``after(state, summary)`` is the one behind it."""
    held = blocks.select("node_id", F.struct("block", summary.alias("f")).alias("_b")).groupBy("node_id").agg(F.sort_array(F.collect_list("_b")).alias("_bs"))
    none = F.array().cast(f"array<struct<block:bigint,start:{_kind(held, first)}>>")
    step = lambda acc, b: F.struct(after(acc["now"], b["f"]).alias("now"), F.concat(acc["out"], F.array(F.struct(b["block"].alias("block"), acc["now"].alias("start")))).alias("out"))
    return held.select("node_id", F.inline(F.aggregate("_bs", F.struct(first.alias("now"), none.alias("out")), step, lambda acc: acc["out"])))


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema[0].dataType.simpleString()


def _walked(blocks: DataFrame, starts: DataFrame, step, outs: list[str]) -> DataFrame:
    """The rows of each block with the states that ``step(state, row)`` goes through from the block's start."""
    # the starts come dealt by node alone, which would serve the join too and bring a whole history into one task
    joined = blocks.repartition("node_id", "block").join(starts.repartition("node_id", "block"), ["node_id", "block"])
    kind = f"array<struct<window_seq:bigint,{','.join(f'{x}:double' for x in outs)}>>"

    def one(acc, r):
        now = step(acc["now"], r)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(r["window_seq"].alias("window_seq"), *[now[x].alias(x) for x in outs]))).alias("out"))

    done = F.aggregate("rows", F.struct(c("start").alias("now"), F.array().cast(kind).alias("out")), one, lambda acc: acc["out"])
    return joined.select("node_id", F.inline(done))


def carried(rows: DataFrame, keep: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(node_id, window_seq, raw) of rows(node_id, window_seq, fresh, signal): without a signal the larger of the fresh
    score and ``keep`` of the score before; null scores count 0."""
    given = rows.select("node_id", "window_seq", F.coalesce(c("fresh"), lit(0.0)).alias("fresh"), F.coalesce(c("signal"), lit(False)).alias("signal"))
    blocks = _blocks(given, ["fresh", "signal"], block)
    both = lambda a, b: F.struct(a.alias("a"), b.alias("b"))  # noqa: E731  # the function x -> max(a * x, b)
    summary = F.aggregate("rows", both(lit(1.0), lit(0.0)), lambda f, r: both(F.when(r["signal"], 0.0).otherwise(f["a"] * keep), F.when(r["signal"], r["fresh"]).otherwise(F.greatest(f["b"] * keep, r["fresh"]))))
    starts = _starts(blocks, summary, F.struct(lit(0.0).alias("raw")), lambda x, f: F.struct(F.greatest(f["a"] * x["raw"], f["b"]).alias("raw")))
    return _walked(blocks, starts, lambda x, r: F.struct(F.when(r["signal"], r["fresh"]).otherwise(F.greatest(x["raw"] * keep, r["fresh"])).alias("raw")), ["raw"])


def _peak_after(pieces: Column, slope: Column, x: Column) -> Column:
    """The peak that leaves a block that x enters: the first piece whose bound x is not above, else x decayed."""
    return F.coalesce(F.get(F.filter(pieces, lambda p: x <= p["to"]), lit(0))["value"], x * slope)


def smoothed(rows: DataFrame, alpha: float = 0.3, decay: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(node_id, window_seq, raw, ewma, peak, effective) of rows(node_id, window_seq, raw).

    The mean starts with the first score; the peak is the score where that is not below it, else it decays.
    """
    blocks = _blocks(rows.select("node_id", "window_seq", c("raw").cast("double").alias("raw")), ["raw"], block)
    keep = 1.0 - alpha
    line = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    mean = F.aggregate("rows", line(lit(1.0), lit(0.0)), lambda f, r: line(f["p"] * keep, f["q"] * keep + r["raw"] * alpha))
    fresh = F.aggregate("rows", lit(None).cast("double"), lambda m, r: F.when(m.isNull(), r["raw"]).otherwise(m + (r["raw"] - m) * alpha))
    no_pieces = F.array().cast("array<struct<to:double,value:double>>")

    def earlier(f, r):
        """The function of a block's end, preceded by one more window."""
        value = _peak_after(f["pieces"], f["slope"], r["raw"])
        rest = F.filter(F.transform(f["pieces"], lambda p: F.struct((p["to"] / decay).alias("to"), p["value"].alias("value"))), lambda p: p["to"] > r["raw"])
        own = F.array(F.struct(r["raw"].alias("to"), value.alias("value")))
        same = F.coalesce(F.get(rest, lit(0))["value"] == value, lit(False))  # one piece up to the larger bound
        return F.struct(F.when(same, rest).otherwise(F.concat(own, rest)).alias("pieces"), (f["slope"] * decay).alias("slope"))

    peak = F.aggregate(F.reverse("rows"), F.struct(no_pieces.alias("pieces"), lit(1.0).alias("slope")), earlier)
    summary = F.struct(mean["p"].alias("p"), mean["q"].alias("q"), fresh.alias("fresh"), peak["pieces"].alias("pieces"), peak["slope"].alias("slope"))
    state = lambda m, p: F.struct(m.alias("ewma"), p.alias("peak"))
    after = lambda x, f: state(F.when(x["ewma"].isNull(), f["fresh"]).otherwise(x["ewma"] * f["p"] + f["q"]), _peak_after(f["pieces"], f["slope"], x["peak"]))
    starts = _starts(blocks, summary, state(lit(None).cast("double"), lit(0.0)), after)

    def step(x, r):
        mean_ = F.when(x["ewma"].isNull(), r["raw"]).otherwise(x["ewma"] + (r["raw"] - x["ewma"]) * alpha)
        return F.struct(mean_.alias("ewma"), F.when(r["raw"] >= x["peak"], r["raw"]).otherwise(x["peak"] * decay).alias("peak"), r["raw"].alias("raw"))

    starts = starts.select("node_id", "block", F.struct("start.ewma", "start.peak", lit(None).cast("double").alias("raw")).alias("start"))
    out = _walked(blocks, starts, step, ["raw", "ewma", "peak"])
    return out.withColumn("effective", F.greatest("ewma", "peak"))
