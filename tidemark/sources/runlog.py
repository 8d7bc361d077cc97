"""Run log: day records of backtests as an append-only set of tables with an atomic manifest.

A run's records are written to a folder of their own under a name that no other attempt has. Only when all of it is there
one small manifest file is put in place by a rename, which either happens or doesn't. Readers start at the manifest, so a run
whose writer died, or still writes, or wrote twice, isn't seen or is seen once and whole.

    root/data/<attempt>/part-*.parquet      a row for each day: dt and nested records
    root/manifest/<run_id>.json             {"run_id", "attempt", "days", "at"}
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "map<string, double>"
DAY = (
    f"dt date, factors map<string, struct<type: string, values: {VALUES}>>, "
    "signals map<string, struct<signal: double, ts_contribution: double, xs_contribution: double, pair_contribution: double>>, "
    f"positions {VALUES}, trades array<struct<ticker: string, action: string, quantity: double, price: double>>, "
    "pnl struct<total_value: double, cash: double, positions_value: double, daily_return: double, cumulative_return: double>, "
    "volatility struct<target: double, realized: double, scale: double>, metadata map<string, string>"
)
LEVELS = ("factors", "signals", "positions", "trades", "pnl", "volatility", "metadata")


@cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-log-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that a cluster shares (spark.checkpoint.dir); a session in one process may use a temporary one."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def _mapped(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """dt and a map from `key` to value; rows without a key are left out, of equal keys the largest value is kept."""
    one = rows.where(F.col(key).isNotNull() & F.col("dt").isNotNull()).groupBy("dt", F.col(key).cast("string").alias("_key")).agg(F.max(value).alias("_value"))
    return one.groupBy("dt").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias("_map"))


def days(
    factors: DataFrame | None = None, signals: DataFrame | None = None, positions: DataFrame | None = None, trades: DataFrame | None = None,
    pnl: DataFrame | None = None, volatility: DataFrame | None = None, metadata: DataFrame | None = None, levels: tuple[str, ...] = LEVELS,
) -> DataFrame:
    """Day records (DAY) from long tables: factors (dt, factor, ticker, value, type), signals (dt, ticker, signal and
    contributions), positions (dt, ticker, value), trades (dt, ticker, action, quantity, price), pnl and volatility (dt and the
    record's fields), metadata (dt, key, value). Tables that aren't in `levels` are left out; missing fields are NULL."""
    fields = {f.name: f.dataType for f in _schema()}
    parts: dict[str, DataFrame] = {}

    def record(df: DataFrame, type_) -> Column:
        return F.struct(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in type_.fields))

    if factors is not None:
        kind = F.col("type") if "type" in factors.columns else F.lit("UNKNOWN")
        named = factors.where("factor is not null and ticker is not null and dt is not null").groupBy("dt", "factor", "ticker").agg(F.max(F.struct("value", kind.alias("type"))).alias("v"))
        each = named.groupBy("dt", "factor").agg(F.struct(F.max("v.type").alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "v.value")))).alias("values")).alias("_of"))
        parts["factors"] = each.groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("factor", "_of"))).alias("_map"))
    if signals is not None:
        parts["signals"] = _mapped(signals, "ticker", record(signals, fields["signals"].valueType))
    if positions is not None:
        parts["positions"] = _mapped(positions, "ticker", F.col("value").cast("double"))
    if trades is not None:
        parts["trades"] = trades.where("dt is not null").groupBy("dt").agg(F.array_sort(F.collect_list(record(trades, fields["trades"].elementType))).alias("_map"))
    for name, df in (("pnl", pnl), ("volatility", volatility)):
        if df is not None:
            parts[name] = df.where("dt is not null").groupBy("dt").agg(F.max(record(df, fields[name])).alias("_map"))
    if metadata is not None:
        parts["metadata"] = _mapped(metadata, "key", F.col("value").cast("string"))
    parts = {n: df for n, df in parts.items() if n in levels}
    if not parts:
        raise ValueError("a log needs a table of one of its levels")
    out = None
    for name, df in parts.items():
        df = df.withColumnRenamed("_map", name)
        out = df if out is None else out.join(df, "dt", "full")
    return out.select("dt", *((F.col(n) if n in parts else F.lit(None)).cast(fields[n]).alias(n) for n in LEVELS))


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(DAY)


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, records: DataFrame) -> str:
        """Day records in the folder of a new attempt, which no reader sees yet."""
        attempt = uuid.uuid4().hex
        records.select("dt", *LEVELS).write.parquet(f"{self.root}/data/{attempt}")
        return attempt

    def commit(self, run_id: str, attempt: str) -> None:
        """Make a written attempt the run's records. Raises if the run has some already."""
        if not run_id or "/" in run_id or run_id.startswith((".", "_")):
            raise ValueError(f"no name for a run: {run_id!r}")
        n = self.spark.read.parquet(f"{self.root}/data/{attempt}").count()
        fs, final = self._fs(f"{self.root}/manifest/{run_id}.json")
        _, draft = self._fs(f"{self.root}/manifest/.{run_id}-{attempt}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"run_id": run_id, "attempt": attempt, "days": n, "at": time.time()}).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise FileExistsError(f"run {run_id!r} is in the log already")

    def append(self, run_id: str, records: DataFrame) -> None:
        self.commit(run_id, self.write(records))

    def runs(self) -> DataFrame:
        """run_id, attempt, days, at of whole runs; a row for each run."""
        fs, folder = self._fs(f"{self.root}/manifest")
        schema = "run_id string, attempt string, days long, at double"
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/manifest")

    def read(self, *run_ids: str) -> DataFrame:
        """Day records of these runs (of all without names) with run_id."""
        found = self.runs()
        if run_ids:
            found = found.where(F.col("run_id").isin(*run_ids))
        rows = found.collect()  # a row for each run
        if missing := set(run_ids) - {r.run_id for r in rows}:
            raise KeyError(f"no whole run {sorted(missing)}")
        if not rows:
            return self.spark.createDataFrame([], f"run_id string, {DAY}")
        attempt = F.element_at(F.split(F.input_file_name(), "/"), -2)
        days_ = self.spark.read.schema(DAY).parquet(*(f"{self.root}/data/{r.attempt}" for r in rows)).withColumn("attempt", attempt)
        names = self.spark.createDataFrame([(r.run_id, r.attempt) for r in rows], "run_id string, attempt string")
        return days_.join(F.broadcast(names), "attempt").select("run_id", "dt", *LEVELS)

    def tables(self, *run_ids: str) -> dict[str, DataFrame]:
        """Long tables of runs: factors, signals, positions, trades, pnl, volatility, metadata."""
        log = self.read(*run_ids)
        day = ("run_id", "dt")
        each = log.select(*day, F.explode("factors").alias("factor", "_of"))
        return {
            "factors": each.select(*day, "factor", F.col("_of.type").alias("type"), F.explode("_of.values").alias("ticker", "value")),
            "signals": log.select(*day, F.explode("signals").alias("ticker", "_of")).select(*day, "ticker", "_of.*"),
            "positions": log.select(*day, F.explode("positions").alias("ticker", "value")),
            "trades": log.select(*day, F.inline("trades")),
            "pnl": log.where("pnl is not null").select(*day, "pnl.*"),
            "volatility": log.where("volatility is not null").select(*day, "volatility.*"),
            "metadata": log.select(*day, F.explode("metadata").alias("key", "value")),
        }

    def vacuum(self) -> int:
        """Delete the folders of attempts that no manifest names, and return their number. Only for a log that nobody writes to."""
        fs, folder = self._fs(f"{self.root}/data")
        if not fs.exists(folder):
            return 0
        known = {r.attempt for r in self.runs().collect()}
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in known]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
