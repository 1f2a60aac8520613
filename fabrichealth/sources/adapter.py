"""Telemetry views over general event tables, so that every operator runs on given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.schemas import COUNTER_KINDS

EPOCH_US, WINDOW_US = 1_704_067_200_000_000, 21_600_000_000
NODES = 8
#: What each kind of business event stands for.
KINDS = {"click": "IrqEntry", "view": "CqCompletion", "purchase": "SlabAlloc", "signup": "NapiPoll", "error": "HardwareCounter"}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + F.round(F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _kind(kind: Column, k: Column) -> Column:
    """Some allocations are frees, and some polls packets."""
    return F.when((kind == "SlabAlloc") & (k % 5 == 4), "SlabFree").when((kind == "NapiPoll") & (k % 3 == 2), "NetifReceive").otherwise(kind)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as telemetry: node, window and the fields of each kind."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = raw.select(
        "event_id",
        (F.col("user_id") % NODES).alias("node_id"),
        micros(F.col("ts")).alias("ts_us"),
        _kind(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")), k).alias("kind"),
        (F.round(F.col("value") * 100).cast("long") * 10).alias("latency_ns"),
        k.alias("k"),
    )
    rows = rows.select(
        "*",
        F.floor((F.col("ts_us") - EPOCH_US) / WINDOW_US).cast("long").alias("window_seq"),
        (F.col("k") % 4).cast("int").alias("cpu"),
        (F.col("event_id") % 97).alias("qp"),
        (F.col("event_id") % 53 == 0).alias("is_error"),
        ((F.col("k") + 1) * 64).alias("bytes_req"),
        ((F.col("k") + 1) * 128).alias("bytes_alloc"),
        ((F.col("k") + 1) * 100).alias("len"),
        F.lit(64).cast("long").alias("budget"),
        (F.col("k") % 65).alias("work_done"),
        (1 + F.col("k") % 2).cast("int").alias("port"),
        (F.col("k") % 17).cast("int").alias("counter"),
    )
    total = F.sum("latency_ns").over(W.partitionBy("node_id", "port", "counter", "kind").orderBy("ts_us", "event_id"))
    return rows.withColumn("reading", F.when(F.col("kind") == "HardwareCounter", total % 100_000))


def counter_kind(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in COUNTER_KINDS]), index)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a heavy completion stream: node, queue pair, latency and a daily window."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        (F.col("l_suppkey") % 64).alias("node_id"),
        (F.col("l_partkey") % 97).alias("qp"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("latency_ns"),
        F.unix_date(F.to_date("l_shipdate")).cast("long").alias("window_seq"),
    )


#: The same views in DuckDB's SQL.
EV = f"""ev0 as (select event_id, user_id % {NODES} as node_id, epoch_us(ts) as ts_us,
  case event_type when 'click' then 'IrqEntry' when 'view' then 'CqCompletion' when 'purchase' then 'SlabAlloc' when 'signup' then 'NapiPoll' when 'error' then 'HardwareCounter' end as kind,
  cast(round(value * 100) as bigint) * 10 as latency_ns, cast(json_extract_string(props, '$.k') as bigint) as k from events),
ev1 as (select * replace (case when kind = 'SlabAlloc' and k % 5 = 4 then 'SlabFree' when kind = 'NapiPoll' and k % 3 = 2 then 'NetifReceive' else kind end as kind), cast(floor((ts_us - {EPOCH_US}) / {WINDOW_US}) as bigint) as window_seq, cast(k % 4 as integer) as cpu, event_id % 97 as qp, event_id % 53 = 0 as is_error,
  (k + 1) * 64 as bytes_req, (k + 1) * 128 as bytes_alloc, (k + 1) * 100 as len, cast(64 as bigint) as budget, k % 65 as work_done, cast(1 + k % 2 as integer) as port, cast(k % 17 as integer) as counter from ev0),
ev as (select *, case when kind = 'HardwareCounter' then cast(sum(latency_ns) over (partition by node_id, port, counter, kind = 'HardwareCounter' order by ts_us, event_id) % 100000 as bigint) end as reading from ev1)"""
