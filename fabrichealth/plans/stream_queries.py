"""Queries that run as streams over replayed files, with event-time timers and bounded state, to their end."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.operators import alerting, rules
from fabrichealth.plans.base import events, query, wins
from fabrichealth.plans.state_queries import _alr, alerts, rule_weights, state_query
from fabrichealth.plans.verdict_queries import rounded, verdict_query
from fabrichealth.sources import event_source
from fabrichealth.sources.adapter import EPOCH_US, WINDOW_US
from fabrichealth.sources.store import settle, shared_dir
from fabrichealth.streaming import jobs

c, lit = F.col, F.lit
#: Files that a table is replayed from, in order of time.
FILES = 3


def replayed(df, order: str, time: str, until_us: int):
    """The rows as files in order of ``order``, behind them the marker of the end; the stream of them, a file a batch."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "replay")
    df = settle(df, "rows")  # every file reads them, and each is written by one task
    low, high = df.agg(F.min(order), F.max(order)).first()
    cuts = [low + (high - low + 1) * i // FILES for i in range(FILES)] + [high + 1] if low is not None else []
    for a, b in zip(cuts, cuts[1:]):
        df.filter((c(order) >= a) & (c(order) < b)).coalesce(1).write.mode("append").parquet(path)
    jobs.end_of_data(spark, path, df.schema, time, until_us)
    return jobs.replay(spark, path, df.schema)


def finished(stream):
    """Every row of a stream that ends."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, "stream")
    query_ = jobs.to_tables(stream, f"{path}/out", f"{path}/checkpoint")
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


def window_end(seq):
    return F.timestamp_micros((seq + 1) * WINDOW_US + EPOCH_US)


def stream_verdicts(spark, sf_dir):
    """The verdicts of the windows that have events, sent as a stream; the empty ones come from timers."""
    windows = rules.fold_input(wins(spark, sf_dir).filter("n_events > 0").withColumn("window_end", window_end(c("window_seq"))), SCALED, trend=False, keep=("window_end",))
    first, last = events(spark, sf_dir).agg(F.min("window_seq"), F.max("window_seq")).first()
    if first is None:
        first = last = 0
    source = replayed(windows, "window_seq", "window_end", (last + 1) * WINDOW_US + EPOCH_US)
    return finished(jobs.verdict_stream(source, SCALED, rule_weights(spark, sf_dir), WINDOW_US, EPOCH_US, start=first))


verdict_query("str_5_stream_verdict", "select * from vd")(lambda spark, sf_dir: rounded(stream_verdicts(spark, sf_dir)))


@query("str_3_final_flush", "select node_id, window_seq, count(*) as n_events, cast(sum(latency_ns) as bigint) as latency_total, max(latency_ns) as latency_max from ev group by all", "ev")
def _(spark, sf_dir):
    """Append mode gives a window when the watermark has passed it; the marker closes those at the end."""
    rows = events(spark, sf_dir).select("node_id", "ts_us", F.timestamp_micros("ts_us").alias("event_time"), "latency_ns")
    last = rows.agg(F.coalesce(F.max("ts_us"), lit(0))).first()[0]
    source = replayed(rows, "ts_us", "event_time", last + 2 * WINDOW_US)
    seq = F.floor((F.unix_micros("window.start") - EPOCH_US) / WINDOW_US).cast("long")
    windows = finished(jobs.windowed(source, length=f"{WINDOW_US // 1_000_000} seconds", late="1 seconds"))
    return windows.select("node_id", seq.alias("window_seq"), "n_events", c("latency_total").cast("long").alias("latency_total"), "latency_max").filter("node_id is not null")


#: The bounded map of the query: so few entries that the 97 items of a node push each other out.
CAPACITY, FRESH_US, EVICT_US = 16, 86_400_000_000, 3 * 86_400_000_000
_lru = f""", x as (select node_id, ts_us, event_id, qp as item, kind = 'IrqEntry' as put from ev where kind in ('IrqEntry', 'CqCompletion')),
p as materialized (select *, row_number() over (partition by node_id order by ts_us, event_id) as rn, lead(ts_us) over (partition by node_id, item order by ts_us, event_id) as next_us from x where put),
pn as materialized (select *, lead(rn) over (partition by node_id, item order by rn) as next_rn from p),
oth as (select a.node_id, a.rn, min(b.rn) as rn2 from p a join p b on b.node_id = a.node_id and b.item <> a.item and b.rn > a.rn and b.ts_us - a.ts_us <= {EVICT_US} group by a.node_id, a.rn, b.item),
cth as (select node_id, rn, rn2 from oth qualify row_number() over (partition by node_id, rn order by rn2) = {CAPACITY}),
lv as (select pn.*, cth.rn2 as evict_rn from pn left join cth using (node_id, rn)),
gone as (select lv.*, e.ts_us as evict_us, e.event_id as evict_id from lv left join p e on e.node_id = lv.node_id and e.rn = lv.evict_rn and (lv.next_rn is null or lv.evict_rn < lv.next_rn)),
g as (select x.*, p.ts_us as put_us, p.event_id as put_id from x asof left join (select *, cast(ts_us as hugeint) * 1000000000 + event_id as o from p) p on p.node_id = x.node_id and p.item = x.item and p.o <= cast(x.ts_us as hugeint) * 1000000000 + x.event_id where not x.put)"""
_lru_rows = f""" select g.node_id, g.ts_us as event_us, g.event_id, g.item,
  case when gone.event_id is null or g.ts_us - g.put_us > {EVICT_US} or (gone.evict_us is not null and (gone.evict_us, gone.evict_id) < (g.ts_us, g.event_id)) then null else g.put_id end as value,
  case when value is not null then g.ts_us - g.put_us end as age_us, case when value is null then 'missing' when age_us > {FRESH_US} then 'stale' else 'found' end as outcome
  from g left join gone on gone.node_id = g.node_id and gone.event_id = g.put_id
union all select node_id, evict_us, evict_id, item, event_id, evict_us - ts_us, 'evicted' from gone where evict_us is not null
union all select node_id, ts_us + {EVICT_US}, null, item, event_id, {EVICT_US}, 'expired' from gone where evict_us is null and (next_us is null or next_us - ts_us > {EVICT_US})"""


def map_rows(spark, sf_dir):
    """Work requests write their queue pair into a node's map, completions look theirs up."""
    ev = events(spark, sf_dir).filter(c("kind").isin("IrqEntry", "CqCompletion"))
    return ev.select("node_id", c("ts_us").alias("event_us"), "event_id", c("qp").alias("item"), c("event_id").alias("value"), (c("kind") == "IrqEntry").alias("put"), F.timestamp_micros("ts_us").alias("event_time"))


@query("str_6_bounded_state", _lru + _lru_rows, "ev")
def _(spark, sf_dir):
    rows = map_rows(spark, sf_dir)
    last = rows.agg(F.coalesce(F.max("event_us"), lit(0))).first()[0]
    source = replayed(rows, "event_us", "event_time", last + EVICT_US + 10_000_000)
    return finished(jobs.bounded_lookups(source, CAPACITY, FRESH_US, EVICT_US))


MAX_AGE_US = 3_600_000_000


@query("join_3_stream", f", s as (select node_id, cpu, ts_us, max(event_id) as id from ev where kind = 'IrqEntry' group by all), l as (select * from ev where kind = 'CqCompletion') select l.node_id, l.cpu, l.event_id, l.ts_us as event_us, case when l.ts_us - s.ts_us <= {MAX_AGE_US} then s.id end as matched_id, case when l.ts_us - s.ts_us <= {MAX_AGE_US} then s.ts_us end as matched_us from l asof left join s on l.node_id = s.node_id and l.cpu = s.cpu and s.ts_us <= l.ts_us", "ev")
def _(spark, sf_dir):
    ev = events(spark, sf_dir).filter(c("kind").isin("IrqEntry", "CqCompletion")).select("node_id", "cpu", c("ts_us").alias("event_us"), "event_id", "kind", F.timestamp_micros("ts_us").alias("event_time"))
    last = ev.agg(F.coalesce(F.max("event_us"), lit(0))).first()[0]
    source = replayed(ev, "event_us", "event_time", last + 1_000_000)
    side = lambda kind: source.filter((c("kind") == kind) | c("kind").isNull())  # noqa: E731  # the marker has no kind
    return finished(jobs.as_of_stream(side("CqCompletion"), side("IrqEntry"), ["node_id", "cpu"], MAX_AGE_US))


#: Seconds of an evaluation of the alert rules, and until a lasting group is told again in these queries.
EVALUATION, REPEAT = 15, 600
_groups = f""", f as materialized (select distinct node_id, alertname, severity, window_seq as w from al), hz as (select max(window_seq) as last from wi),
gr as (select node_id, alertname, severity, case severity when 'CRITICAL' then {alerting.CRITICAL_WAIT} else {alerting.WAIT} end as wait, min(w) as w0, max(w) as w1 from f group by all),
gw as (select node_id, alertname, severity, wait, w0, unnest(generate_series(w0, w1 + 12)) as w from gr),
tk as materialized (select gw.*, max(f.w) over (partition by gw.node_id, gw.alertname, gw.severity order by gw.w) as before, min(f.w) over (partition by gw.node_id, gw.alertname, gw.severity order by gw.w rows between 1 following and unbounded following) as nxt
  from gw left join f on f.node_id = gw.node_id and f.alertname = gw.alertname and f.severity = gw.severity and f.w = gw.w),
ac as materialized (select *, {EVALUATION} * w + wait - {EVALUATION} * before <= {alerting.RESOLVE} as active from tk),
nt as (select ac.*, cast(null as bigint) as sent from ac where w = w0 union all
  select ac.*, case when not nt.active then null when nt.sent is null or {EVALUATION} * (nt.w - nt.sent) >= {REPEAT} then nt.w else nt.sent end
  from nt join ac on ac.node_id = nt.node_id and ac.alertname = nt.alertname and ac.severity = nt.severity and ac.w = case when nt.active then nt.w + {alerting.INTERVAL // EVALUATION} else nt.nxt end),
out as (select node_id, alertname, severity, {EPOCH_US} + ({EVALUATION} * w + wait) * 1000000 as at_us, case when active and (sent is null or {EVALUATION} * (w - sent) >= {REPEAT}) then 'firing' when not active and sent is not null then 'resolved' end as kind from nt)
select node_id, alertname, severity, at_us, kind from out, hz where kind is not null and at_us <= {EPOCH_US} + ({EVALUATION} * last + 120) * 1000000"""


def firing(spark, sf_dir):
    """Alerts by the time of their evaluation, and the time up to which notifications are told."""
    last = events(spark, sf_dir).agg(F.coalesce(F.max("window_seq"), lit(0))).first()[0]
    return alerts(spark, sf_dir).select(*alerting.GROUP, (EPOCH_US + c("window_seq") * EVALUATION * 1_000_000).alias("event_us")).distinct(), EPOCH_US + (EVALUATION * last + 120) * 1_000_000


@state_query("alr_3_grouping", _alr() + _groups)
def _(spark, sf_dir):
    rows, until = firing(spark, sf_dir)
    return alerting.notifications(rows, until, repeat=REPEAT)


@state_query("alr_3_timers", _alr() + _groups)
def _(spark, sf_dir):
    rows, until = firing(spark, sf_dir)
    source = replayed(rows.withColumn("event_time", F.timestamp_micros("event_us")), "event_us", "event_time", until)
    return finished(jobs.notification_stream(source, repeat=REPEAT))


def arrays(spark, sf_dir):
    """Events written as JSON arrays, a file for each node and span of windows; the folder."""
    kinds = {"IrqEntry": ("cpu",), "SlabAlloc": ("cpu", "bytes_req", "bytes_alloc", "latency_ns"), "SlabFree": ("cpu",), "NapiPoll": ("cpu", "budget", "work_done"), "NetifReceive": ("cpu", "len"), "CqCompletion": ("cpu", "latency_ns", "is_error"), "HardwareCounter": ("cpu",)}
    body = lit(None).cast("string")
    for kind, fields in kinds.items():
        inner = F.struct((c("ts_us") * 1000).alias("timestamp_ns"), *fields)
        body = F.when(c("kind") == kind, F.concat(lit(f'{{"{kind}":'), F.to_json(inner), lit("}"))).otherwise(body)
    rows = events(spark, sf_dir).select(c("node_id").alias("node"), F.floor(c("window_seq") / SPAN).alias("span"), body.alias("body"))
    path = shared_dir(spark, "arrays")
    whole = rows.groupBy("node", "span").agg(F.concat(lit("["), F.array_join(F.collect_list("body"), ","), lit("]")).alias("value"))
    whole.write.partitionBy("span", "node").text(path)
    return path


#: Windows of one file.
SPAN = 40


def landed_events(spark, sf_dir):
    event_source.register(spark)
    found = spark.read.format(event_source.NAME).load(arrays(spark, sf_dir))
    named = lambda key: F.regexp_extract("file", rf"{key}=(-?\d+)", 1).cast("long").alias(key)
    return found.select(named("node"), named("span"), "*")


@query("ext_3_event_source", "select node_id as node, ts_us * 1000 as timestamp_ns, kind, cpu, case when kind in ('SlabAlloc', 'CqCompletion') then latency_ns end as latency_ns, case when kind = 'NetifReceive' then len end as len from ev", "ev")
def _(spark, sf_dir):
    return landed_events(spark, sf_dir).select("node", "timestamp_ns", "kind", "cpu", "latency_ns", "len")


@query("src_4_ordered_replay", f"select node_id as node, window_seq // {SPAN} as span, count(*) as n, min(ts_us) * 1000 as first_ns, true as in_order from ev group by all", "ev")
def _(spark, sf_dir):
    """The source gives a file's events in order of time: read off the order in which its rows came."""
    rows = landed_events(spark, sf_dir).select("node", "span", "timestamp_ns", F.monotonically_increasing_id().alias("came"))
    before = F.lag("timestamp_ns").over(W.partitionBy("node", "span").orderBy("came"))
    told = rows.withColumn("_ok", F.coalesce(before <= c("timestamp_ns"), lit(True)))
    return told.groupBy("node", "span").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.min("_ok").alias("in_order"))
