"""Readers of landed telemetry: JSON events and scenarios, text snapshots, inventories and metric dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabrichealth.schemas import COUNTER_FILES, SCENARIO_SCHEMA

c = F.col
#: A scenario larger than this is refused.
MAX_BYTES, MAX_EVENTS = 100_000_000, 10_000_000


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files as rows; a bare event array is a scenario without expectations. Broken files are left out, see ``rejected``."""
    return parse_scenarios(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value")))


def rejected(text: DataFrame) -> DataFrame:
    """(file, reason) of the JSON documents(file, value) that are no scenario."""
    return _parsed(text).filter("events is null").select("file", F.lit("no scenario").alias("reason"))


def _refuse(where: Column, value: Column, what: str) -> Column:
    return F.when(where, F.raise_error(F.concat(F.lit(f"scenario with too many {what}: "), c("file")))).otherwise(value)


def parse_scenarios(text: DataFrame) -> DataFrame:
    """scenario, events and expected_states of JSON documents(file, value); one above the fixed sizes is an error."""
    return _parsed(text).filter("events is not null").drop("file")


def _parsed(text: DataFrame) -> DataFrame:
    event = SCENARIO_SCHEMA.split("events array<", 1)[1].split(">>>>, ", 1)[0] + ">>>"
    bare = F.startswith("value", F.lit("["))
    parsed = text.withColumn("value", _refuse(F.octet_length("value") > MAX_BYTES, c("value"), "bytes")).select(
        "file",
        F.when(~bare, F.from_json("value", SCENARIO_SCHEMA)).alias("s"),
        F.when(bare, F.from_json("value", f"array<{event}>")).alias("e"),
    )
    name = F.coalesce("s.name", F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1))
    events = F.coalesce("s.events", "e")
    return parsed.select("file", name.alias("scenario"), _refuse(F.size(events) > MAX_EVENTS, events, "events").alias("events"), "s.expected_states")


def scenario_events(found: DataFrame) -> DataFrame:
    """scenario, position, kind and the fields of every event."""
    rows = found.select("scenario", F.posexplode("events").alias("position", "_e")).select("scenario", "position", F.explode("_e").alias("kind", "_f"))
    flat = rows.select("scenario", "position", "kind", "_f.*")
    return flat.withColumns({"counter_kind": F.map_keys("counter")[0], "counter_value": F.map_values("counter")[0]}).drop("counter")


def scenario_expectations(found: DataFrame) -> DataFrame:
    return found.select("scenario", F.inline("expected_states")).withColumn("expected_state", F.upper("expected_state"))


def port_readings(readings: DataFrame) -> DataFrame:
    """Landed counter files: known names only, values that don't parse are dropped."""
    kinds = F.create_map(*[F.lit(x) for kv in COUNTER_FILES.items() for x in kv])
    rows = readings.withColumns({"counter_kind": F.try_element_at(kinds, c("file_name")), "counter_value": F.expr("try_cast(trim(value) as decimal(20,0))")})
    return rows.filter("counter_kind is not null and counter_value is not null").drop("value", "file_name")


def _lines(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("node_id", "snapshot", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def interrupts(snapshots: DataFrame) -> DataFrame:
    """Per-CPU totals of interrupts text: the header names the CPUs, cells that are no numbers are skipped."""
    head = F.size(F.filter(F.split(F.trim(F.split("text", "\n")[0]), r"\s+"), lambda x: x.rlike("^CPU")))
    rows = snapshots.withColumn("cpus", head).select("node_id", "snapshot", "cpus", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cells = rows.filter((c("line_no") > 0) & F.contains("line", F.lit(":"))).select("node_id", "snapshot", F.posexplode(F.slice(F.split(F.trim(F.regexp_replace("line", r"^[^:]*:", "")), r"\s+"), F.lit(1), F.col("cpus"))).alias("cpu", "cell"))
    return cells.groupBy("node_id", "snapshot", "cpu").agg(F.coalesce(F.sum(F.expr("try_cast(cell as bigint)")), F.lit(0)).alias("count"))


def slabinfo(snapshots: DataFrame) -> DataFrame:
    """Active objects, all objects and active slabs; two header lines and short rows are skipped."""
    rows = _lines(snapshots).filter("line_no >= 2").withColumn("w", F.split(F.trim("line"), r"\s+")).filter(F.size("w") >= 14)
    total = lambda i: F.coalesce(F.sum(F.expr(f"try_cast(w[{i}] as bigint)")), F.lit(0))
    return rows.groupBy("node_id", "snapshot").agg(total(1).alias("active_objects"), total(2).alias("objects"), total(13).alias("active_slabs"))


def fragmentation_pct(active: str = "active_objects", whole: str = "objects") -> Column:
    return F.when(c(whole) > 0, (1 - c(active) / c(whole)) * 100).otherwise(F.lit(0.0))


def softnet(snapshots: DataFrame) -> DataFrame:
    """Hexadecimal (processed, dropped, time_squeeze) by CPU; rows with any bad cell are dropped."""
    rows = _lines(snapshots).withColumn("w", F.split(F.trim("line"), r"\s+")).filter((F.size("w") >= 3) & F.forall(F.slice("w", 1, 3), lambda x: x.rlike("^[0-9a-fA-F]{1,16}$")))
    number = lambda i: F.conv(c("w")[i], 16, 10).cast("decimal(20,0)")  # noqa: E731  # unsigned 64 bits
    return rows.select("node_id", "snapshot", c("line_no").alias("cpu"), number(0).alias("processed"), number(1).alias("dropped"), number(2).alias("time_squeeze"))


def peer_probes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("node_id long, timestamp_unix long, interval_secs long, results array<struct<peer: string, rtt_us: double, error: string>>").json(path)
    return rows.select("node_id", "timestamp_unix", "interval_secs", F.inline("results"))


def fresh(probes: DataFrame, now: Column) -> DataFrame:
    """Probes not older than three intervals."""
    return probes.filter(now - c("timestamp_unix") <= 3 * F.greatest("interval_secs", F.lit(1)))


def targets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("targets array<string>, labels map<string,string>").option("multiLine", True).json(path)
    return rows.select(F.explode("targets").alias("target"), "labels")


def metrics_text(lines: DataFrame) -> DataFrame:
    """name, labels and value of exposition lines(line)."""
    part = lambda i: F.regexp_extract("line", r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)", i)
    labels = F.when(part(2) == "", F.create_map().cast("map<string,string>")).otherwise(F.transform_values(F.str_to_map(part(2), F.lit(","), F.lit("=")), lambda k, v: F.btrim(v, F.lit('"'))))
    return lines.filter("line not like '#%'").select(part(1).alias("name"), labels.alias("labels"), F.expr(r"try_cast(regexp_extract(line, '^([a-zA-Z_:][\\w:]*)(?:\\{(.*)\\})?\\s+(\\S+)', 3) as double)").alias("value")).filter("name <> ''")


def processes(rows: DataFrame) -> DataFrame:
    """job_id, pod and environment of landed processes(node_id, pid, comm, cgroup, environ)."""
    job = F.nullif(F.regexp_extract("cgroup", r"job_(\d+)", 1), F.lit(""))
    pod = F.nullif(F.regexp_extract("cgroup", r"/pod([\w-]+)", 1), F.lit(""))
    return rows.select("node_id", "pid", "comm", F.coalesce(job, env("SLURM_JOB_ID")).alias("job_id"), pod.alias("pod"), env("CUDA_VISIBLE_DEVICES").alias("gpus"))


def env(name: str) -> Column:
    """A variable of NUL-separated text; empty is null."""
    found = F.get(F.filter(F.split("environ", "\u0000"), lambda x: F.startswith(x, F.lit(f"{name}="))), F.lit(0))
    return F.nullif(F.replace(F.regexp_replace(found, f"^{name}=", ""), F.lit("\u0000")), F.lit(""))


def device_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("rxe")), "SoftRoCE").when(low.rlike("^(mlx|hfi|qib|ib)"), "HardwareIB").otherwise("Unknown")


def fabric_class(driver: Column, link_layer: Column) -> Column:
    soft = F.lower(driver).rlike("rxe")
    return F.when(soft, "SoftRoCE").when(F.lower(link_layer) == "infiniband", "InfiniBand").when(F.lower(link_layer) == "ethernet", "RoCEv2").otherwise("Unknown")


def dominant(devices: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The value of each node's devices that stands first in an order."""
    rank = F.lit(len(order))
    for i, name in enumerate(order):
        rank = F.when(c(column) == name, i).otherwise(rank)
    return devices.groupBy("node_id").agg(F.min_by(column, rank).alias(column))
