"""Parquet tables: scans with projection and predicates, snapshots, appends and upserts; JSONL and small JSON documents."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.filters import apply_filters

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset, on one machine (tests), a folder of this session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='gleanery-')}")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that it has one fixed content and short lineage."""
    path = f"{shared_folder(df.sparkSession)}/gleanery/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that make a task of work over images, and that are worth a task of their own while cores are idle.
TASK_ROWS, LEAST_ROWS = 10_000, 200


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key to as many tasks as its rows need: a small file of keys, which a scan reads in one task, may stand for much work."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // TASK_ROWS), min(cores, rows // LEAST_ROWS)), key)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: ids of all occurrences look small on disk, but the driver would hold them all."""
    return df.hint("shuffle_merge")


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _filesystem(spark, path)
    return bool(files.exists(where))


def _current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version of a table, or the path itself where it isn't versioned."""
    where, files = _filesystem(spark, path)
    if not files.exists(where):
        return None
    found = sorted(x.getPath().toString() for x in files.listStatus(where) if x.getPath().getName().startswith("v=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    return found[-1] if found else path


#: Buckets of a table that is upserted: an upsert rewrites those that its keys fall into.
BUCKETS = 64
_BUCKET = "__bucket"


def _buckets(folder: str) -> dict | None:
    """What a bucketed version consists of: keys, and the folder of each bucket under the table's path."""
    return read_json(f"{folder}/_buckets.json")


def _read(spark: SparkSession, path: str, folder: str) -> DataFrame:
    made = _buckets(folder)
    return spark.read.parquet(folder) if made is None else spark.read.parquet(*[f"{path}/{f}" for f in made["folders"].values()])


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing_ok: bool = False, filters: Iterable[tuple] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """One table; filters are (column, op, value), all must hold, their columns needn't be selected. Both reach the scan.

    With ``missing_ok`` an absent table is an empty one of ``schema`` (else of the asked columns as STRING).
    """
    folder = _current(spark, path)
    if folder is None:
        if not missing_ok:
            raise FileNotFoundError(path)
        schema = schema or T.StructType([T.StructField(c, T.StringType()) for c in columns or ()])
        df = spark.createDataFrame([], schema)
        return df.select(*columns) if columns else df
    df = _read(spark, path, folder)
    for column, op, value in filters or ():
        df = apply_filters(df, {column: (op.replace("not_in", "not in") if op != "=" else "==", value)})
    return df.select(*columns) if columns is not None else df


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footer; none for an absent table."""
    folder = _current(spark, path)
    if folder is None:
        return []
    try:
        return _read(spark, path, folder).columns
    except AnalysisException:
        return []


def _next(spark: SparkSession, path: str) -> int:
    old = _current(spark, path)
    return int(old.rpartition("v=")[2]) + 1 if old and "v=" in old.rpartition("/")[2] else 1


def _forget(spark: SparkSession, path: str, newest: int) -> None:
    """Delete all versions but the newest two, and bucket folders that neither of them holds."""
    where, files = _filesystem(spark, path)
    held = set()
    for number in (newest, newest - 1):
        made = _buckets(f"{path}/v={number:012d}")
        held |= {f.split("/")[0] for f in made["folders"].values()} if made else set()
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if (name.startswith("v=") and int(name[2:]) < newest - 1) or (name.startswith("d=") and name not in held):
            files.delete(status.getPath(), True)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table: the new version is complete before readers see it, so ``df`` may read the old one; older versions but one go."""
    number = _next(df.sparkSession, path)
    df.write.parquet(f"{path}/v={number:012d}")
    _forget(df.sparkSession, path, number)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to the newest version."""
    folder = _current(df.sparkSession, path)
    if folder and _buckets(folder):
        write_table(_read(df.sparkSession, path, folder).unionByName(df, allowMissingColumns=True), path)
    else:
        df.write.mode("append").parquet(folder or f"{path}/v={1:012d}")


def _write_buckets(df: DataFrame, path: str, keys: Sequence[str], kept: dict[str, str]) -> None:
    """A new version: the buckets of ``df``'s rows as given, the ``kept`` ones where they are. Readers see it once its list and then its mark are there."""
    spark = df.sparkSession
    number, folder = _next(spark, path), f"d={uuid.uuid4().hex}"
    df.withColumn(_BUCKET, _bucket_of(keys)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    where, files = _filesystem(spark, f"{path}/{folder}")
    names = [x.getPath().getName() for x in files.listStatus(where)]
    made = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}
    write_json(f"{path}/v={number:012d}/_buckets.json", {"keys": list(keys), "folders": kept | made})
    claim(f"{path}/v={number:012d}/_SUCCESS")
    _forget(spark, path, number)


def _bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS))


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key isn't among the new ones, and all new rows (as they are, repeats included).

    A key column that is absent raises KeyError, a NULL in a new key ValueError, a changed key type TypeError.
    Columns that either side lacks are NULL.
    """
    for key in keys:
        if key not in new.columns:
            raise KeyError(f"the new rows have no key column {key!r}")
    if new.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count():
        raise ValueError(f"a key ({', '.join(keys)}) of the new rows is null")
    for key in keys:
        if key not in existing.columns:
            raise KeyError(f"the table has no key column {key!r}")
        if existing.schema[key].dataType != new.schema[key].dataType:
            raise TypeError(f"key {key!r} is {existing.schema[key].dataType.simpleString()} in the table and {new.schema[key].dataType.simpleString()} in the new rows")
    kept = existing.join(shuffled(new.select(*keys).distinct()), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_table(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Upsert rows by key into a stored table. It lies in ``BUCKETS`` buckets of its keys, of which only those that hold a new key are read and written again; a table that has other columns or isn't in buckets yet is written once as a whole."""
    spark = new.sparkSession
    folder = _current(spark, path)
    if folder is None:
        upserted(spark.createDataFrame([], new.schema), new, keys)
        if not new.isEmpty():
            _write_buckets(new, path, keys, {})
        else:
            write_table(new, path)
        return
    made, whole = _buckets(folder), _read(spark, path, folder)
    if made is None or made["keys"] != list(keys) or whole.schema.simpleString() != new.select(*[c for c in whole.columns if c in new.columns]).schema.simpleString() or set(new.columns) - set(whole.columns):
        merged = upserted(whole, new, keys)
        if merged.isEmpty():
            write_table(merged, path)
        else:
            _write_buckets(merged, path, keys, {})
        return
    touched = {str(r[0]) for r in new.select(_bucket_of(keys)).distinct().collect()}
    old = [f"{path}/{f}" for k, f in made["folders"].items() if k in touched]
    existing = spark.read.schema(whole.schema).parquet(*old) if old else spark.createDataFrame([], whole.schema)
    merged = upserted(existing, new, keys).select(*whole.columns)
    if touched:
        _write_buckets(merged, path, keys, {k: f for k, f in made["folders"].items() if k not in touched})


def last_per_key(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Shards in order, the last row of each key kept (the last of the last shard that has it): what merging staged shards gives."""
    frames = [df.withColumn("_shard", F.lit(k)).withColumn("_row", F.monotonically_increasing_id()) for k, df in enumerate(shards)]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    names = [c for c in whole.columns if c not in ("_shard", "_row")]
    best = F.max_by(F.struct(*names), F.struct("_shard", "_row")).alias("_best")
    return whole.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(best).select("_best.*")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, record VARIANT) of an append-only log, oldest first in ``line``; lines that are no JSON are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    return lines.select("line", F.try_parse_json("value").alias("record")).where("record is not null")


def read_bytes(path: str) -> bytes | None:
    """A small file of any file system that Spark reaches; None where there is none."""
    where, files = _filesystem(SparkSession.active(), path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(path: str, data: bytes) -> None:
    """Replace a small file in one step: it is written aside and renamed over the old one."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    where, files = _filesystem(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(aside, True)
    out.write(bytearray(data))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = files.makeQualified(where)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(aside), qualified, over)


def claim(path: str) -> bool:
    """Create an empty file; False where it was there already. Of several drivers one gets True."""
    where, files = _filesystem(SparkSession.active(), path)
    files.mkdirs(where.getParent())
    return bool(files.createNewFile(where))


def append_jsonl(path: str, record: Any) -> None:
    """Add a record to a log: a folder of one small file for each, so that any file system takes it and two drivers don't cut each other's lines."""
    write_bytes(f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(record, sort_keys=True, default=str).encode() + b"\n")


def read_log(path: str) -> list[dict]:
    """A small log as dicts, oldest first; malformed lines are skipped."""
    where, files = _filesystem(SparkSession.active(), path)
    if not files.exists(where):
        return []
    names = sorted(x.getPath().toString() for x in files.listStatus(where) if x.getPath().getName().endswith(".json")) if files.getFileStatus(where).isDirectory() else [path]
    out = []
    for line in b"".join(read_bytes(n) or b"" for n in names).splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return [x for x in out if isinstance(x, dict)]


def write_json(path: str, value: Any) -> None:
    """Replace a small JSON document in one step."""
    write_bytes(path, json.dumps(value, indent=2, sort_keys=True, default=str).encode())


def read_json(path: str, default: Any = None) -> Any:
    text = read_bytes(path)
    return default if text is None else json.loads(text)
