"""Reading, normalising and writing bars; tick sources among plain tables."""

from __future__ import annotations

import io
import os
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyarrow import feather, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names that a time column may have, the first found wins (fixed values).
TIME_COLUMNS = ("timestamp", "datetime", "date", "time")
PARQUET, FEATHER, CSV = (".parquet", ".pq"), (".feather", ".fthr"), (".csv",)
#: Other names of assets (fixed values).
ALIASES = {"SP": "SP500", "NDX": "NASDAQ"}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it; a path without a scheme is a local or mounted folder."""
    return fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def exists(path: str) -> bool:
    where, name = _located(path)
    return where.get_file_info(name).type != fs.FileType.NotFound


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, each read on an executor; ``path`` may be a glob that Spark's file listing understands.

    The first file gives the schema, of which alone the driver hears; the others are cast to it.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def described(batches):
        for batch in batches:
            schemas = [feather.read_table(io.BytesIO(c)).schema.serialize().to_pybytes() for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(schemas, pa.binary())], names=["schema"])

    first = files.limit(1).mapInArrow(described, "schema binary").collect()
    if not first:
        raise ValueError(f"no file at {path}")
    known = pa.ipc.read_schema(pa.py_buffer(bytes(first[0].schema)))

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from feather.read_table(io.BytesIO(content)).cast(known).to_batches()

    return files.mapInArrow(rows, spark.createDataFrame(known.empty_table()).schema)


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file or folder of bars by its suffix: Parquet, Feather or CSV; ``ValueError`` for any other.

    Types of a CSV are inferred by a pass over it, unless ``schema`` names them.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in PARQUET:
        return spark.read.parquet(path)
    if suffix in FEATHER:
        return read_feather(spark, path)
    if suffix in CSV:
        return spark.read.csv(path, header=True, inferSchema=schema is None, schema=schema)
    raise ValueError(f"unsupported format: {suffix or path}")


def normalise(df: DataFrame, mode: str = "convert", need_ohlc: bool = False) -> DataFrame:
    """Name the time column ``timestamp``, in UTC without a zone; ``need_ohlc`` also asks for prices and fills volume.

    A zoned time is converted ("convert") or keeps its wall clock ("replace", in the session's zone);
    a time without zone is UTC as it stands. No sort: operators order by window.
    """
    lower = {c.lower(): c for c in df.columns}
    found = next((lower[c] for c in TIME_COLUMNS if c in lower), None)
    if found is None:
        raise ValueError(f"no time column among {df.columns}")
    kind = dict(df.dtypes)[found]
    at = F.col(found)
    if kind == "timestamp" and mode == "convert":
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        at = F.convert_timezone(F.lit(zone), F.lit("UTC"), at.cast("timestamp_ntz"))
    df = df.withColumn("timestamp", at.cast("timestamp_ntz"))
    df = df if found == "timestamp" else df.drop(found)
    if need_ohlc:
        missing = {"open", "high", "low", "close"} - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        df = df if "volume" in df.columns else df.withColumn("volume", F.lit(0.0))
    return df


def load(spark: SparkSession, path: str) -> DataFrame:
    return normalise(scan(spark, path))


def between(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Inclusive bounds as UTC times; a bare date is its midnight. The filter reaches the scan."""
    at = F.col("timestamp")
    if first is not None:
        df = df.where(at >= F.lit(first).cast("timestamp_ntz"))
    return df if last is None else df.where(at <= F.lit(last).cast("timestamp_ntz"))


def bar_path(root: str, asset: str, suffix: str, ext: str = "parquet") -> str:
    """One (asset, timeframe) by the naming convention, aliases resolved."""
    name = asset.strip().upper()
    return f"{root}/ohlcv/{ALIASES.get(name, name)}_ohlcv_{suffix}.{ext}"


def resolve(root: str, asset: str, suffix: str) -> str | None:
    """The first existing file by preference: Parquet, Feather, CSV."""
    paths = (bar_path(root, asset, suffix, e) for e in ("parquet", "feather", "csv"))
    return next((p for p in paths if exists(p)), None)


def inventory(spark: SparkSession, root: str, assets: list[str], suffixes: list[str]) -> DataFrame:
    """asset, suffix, fmt, path, present for every combination."""
    rows = [(a, s, e, p := bar_path(root, a, s, e), exists(p)) for a in assets for s in suffixes for e in ("parquet", "feather", "csv")]
    return spark.createDataFrame(rows, "asset string, suffix string, fmt string, path string, present boolean")


def write(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, CSV or Feather by suffix; an existing target stays unless ``overwrite``.

    Feather is one Arrow IPC file for each partition, written on the executors into a shared folder.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in FEATHER:
        return write_feather(df, path, overwrite)
    if suffix not in PARQUET + CSV:
        raise ValueError(f"unsupported format: {suffix or path}")
    out = df.write.mode("overwrite" if overwrite else "ignore")
    out = out.partitionBy(*partition_by) if partition_by else out
    return out.parquet(path) if suffix in PARQUET else out.csv(path, header=True)


def write_feather(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One file for each partition that has rows, batch by batch; a task run again replaces its file."""
    where, base = _located(path)
    if exists(path):
        if not overwrite:
            return
        where.delete_dir_contents(base)
    where.create_dir(base, recursive=True)

    def rows(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        own, base = _located(path)
        task = TaskContext.get()
        name, draft = f"{base}/part-{task.partitionId():05d}.feather", f"{base}/_part-{task.taskAttemptId()}"
        with own.open_output_stream(draft) as sink, pa.ipc.new_file(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for batch in chain((head,), batches):
                out.write_batch(batch)
        if own.get_file_info(name).type != fs.FileType.NotFound:
            own.delete_file(name)
        own.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["files"])

    df.mapInArrow(rows, "files long").agg(F.sum("files")).collect()


@dataclass
class Registry:
    """Cached frames by (asset, timeframe)."""

    frames: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def get(self, asset: str, suffix: str) -> DataFrame | None:
        return self.frames.get((asset, suffix))

    def put(self, asset: str, suffix: str, df: DataFrame) -> DataFrame:
        self.frames[asset, suffix] = df.cache()
        return df

    def get_or_load(self, asset: str, suffix: str, load_it) -> DataFrame:
        return self.get(asset, suffix) or self.put(asset, suffix, load_it())

    def clear(self, asset: str | None = None) -> None:
        for key in [k for k in self.frames if asset in (None, k[0])]:
            self.frames.pop(key).unpersist()

    def stats(self) -> dict[str, int]:
        return {"frames": len(self.frames), "assets": len({a for a, _ in self.frames})}


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the events table: a symbol for each type, its values as prices, one unit each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.struct("event_id").alias("tie"))


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the lineitem table: unit prices and quantities by return flag and status."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("size"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tie"))
