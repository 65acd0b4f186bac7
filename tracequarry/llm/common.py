"""Helpers that the corpus operators share: input shaping, shared scratch tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of the bytes that one Arrow batch hands to a Python worker.
BATCH_BYTES = 32 << 20
BATCH_ROWS = 2000
#: hot_join: a key of more than this part of all rows is hot.
SHARES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts must not meet in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # older releases bound batches by rows alone
        pass


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own and any other an error, as its executors have disks of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _own.get(sc.applicationId) or _own.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    if "://" not in at:
        at = f"file://{os.path.abspath(at)}"
    return at.rstrip("/")


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string only, so that other columns' names can't clash; null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart and orders them: doc_id (null last), then two hashes of the text. Only rows equal in both share it."""
    return F.struct(doc_id.isNull().alias("bare"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """left, of total rows, left-joined with right, which has one row a key and says in `size` how many rows of left have it.

    Keys of over a SHARES-th of all rows, so at most SHARES rows of right, are broadcast: their rows are never shuffled. The others meet by an exchange in which no key is large.
    """
    hot = F.broadcast(right.filter(F.col(size) * SHARES > total))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col(size) * SHARES <= total), on, "left"), allowMissingColumns=True)


def one_of_equal(rows: DataFrame, on: str, again: DataFrame) -> DataFrame:
    """rows, but of those with a value of `on` that is in `again` only one each."""
    if again.isEmpty():
        return rows
    ties = stored(rows.join(again, on, "left_semi").withColumn("uid", F.monotonically_increasing_id()), "ties")
    return rows.join(again, on, "left_anti").unionByName(ties.join(ties.groupBy(on).agg(F.min("uid").alias("uid")).select("uid"), "uid", "left_semi").drop("uid"))


def packed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct column `row` beside further ones, so that no name of a user's column can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """Back to the columns of docs; new ones take the place of those of their names."""
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def sym(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) of longs: rows (node, component), component the smallest node.

    Alternates large-star and small-star rounds, each a group minimum and a join, until a round
    changes nothing. Every round's edges are a table in the shared folder; the driver sees only a
    count and a checksum. Nodes without an edge are not in the result.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = sym(now)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
