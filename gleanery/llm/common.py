"""What the operators of this subpackage share: text rules, tables in the shared folder, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleanery.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of every word and line rule here: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

_folders: dict[str, str] = {}


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, UPPER.lower())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, on one machine (tests), a folder of this session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='gleanery-')}")


#: Rows of texts that a Python worker and the JVM exchange at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` where it is larger, so that long texts fit several times beside a full heap; and see that the workers can import this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleanery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows written (after lost tasks possibly more than that, but 0 only where there are none)."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` made and that nothing reads any more; other files are left alone."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/gleanery").toUri().getPath() + "/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(own):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted: Spark does that when the driver collects the query's objects, which a long step on a quiet driver may not do until its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (node, component): component is the smallest node reachable.

    Contraction: every node moves to the neighbour (or itself) that comes first in an order, edges are renamed, and
    what still joins two different nodes is contracted again. The first order is that of the ids, which settles stars
    around their smallest node at once; the next ones are hashed, which keeps the number of rounds logarithmic on
    chains of consecutive ids. Each round aggregates before it shuffles, and its joins have a plain exchange on either
    side, so a hub with most of the edges is split. Self loops and repeated edges are allowed; rows with a null end
    are ignored; without edges the result is empty.
    """
    left, right = F.col(a).cast("long"), F.col(b).cast("long")
    graph, many = counted(edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    while many or not maps:
        both = graph.union(graph.select("v", "u"))
        rank = (lambda node: F.xxhash64(node, F.lit(len(maps)))) if maps else (lambda node: F.col(node))
        first = F.min(F.struct(rank("v").alias("h"), "v"))
        own = F.struct(rank("u").alias("h"), F.col("u").alias("v"))
        step = materialize(both.groupBy("u").agg(first.alias("best")).select(F.col("u").alias("node"), F.least("best", own)["v"].alias("to")), "step")
        maps.append(step)
        from_, to = step.select(F.col("node").alias("u"), F.col("to").alias("tu")), step.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        half = graph.join(from_, "u").select("v", "tu")
        renamed = half.join(to, "v").where("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        last, (graph, many) = graph, counted(renamed, "edges")
        release(last)
    root = maps[0].withColumnRenamed("to", "root")
    for step in maps[1:]:
        moved = root.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
        root = moved.select("node", F.coalesce("to", "root").alias("root"))
    root = materialize(root, "roots")
    for step in maps:
        release(step)
    return root.join(root.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
