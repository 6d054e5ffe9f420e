"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without that setting;
    it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="panelwright-"))


def written(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which ends its lineage; dropped with the session, or by :func:`drop`.

    ``files`` at most are written, where a table is too narrow to be worth more.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_paths = [path]
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete written tables (or what :func:`held_by` names) once nothing reads them any more."""
    for table in tables:
        for path in table.__dict__.pop("scratch_paths", ()):
            place, store = _place(table.sparkSession, path)
            store.delete(place, True)
            store.cancelDeleteOnExit(place)


def held_by(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads ``tables``: to drop it is to drop them."""
    df.scratch_paths = [p for t in tables for p in t.__dict__.get("scratch_paths", ())]
    return df


#: Classes of more than this share of all rows (of ten million at least) are looked up in place; no more than its inverse exist.
HOT_SHARE = 1e-4


def looked_up(rows: DataFrame, classes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` rows with what is known of their class, if anything, by the keys (long, never null in ``classes``).

    ``classes`` has a row for each class and its number of rows as ``copies``. Large classes go to all executors,
    10,000 of them at most, so that their rows need not meet in one task.
    """
    least = F.lit(HOT_SHARE * max(n, 1e7))
    values = [c for c in classes.columns if c not in (*keys, "copies")]
    large = F.coalesce("copies", F.lit(0)) > least
    hot = classes.where(large).select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(v).alias(f"hot_{v}") for v in values])
    rest = classes.where(~large).select(*[F.col(k).alias(f"known_{k}") for k in keys], *values)
    names = rows.columns
    for k in keys:
        same = rows[k] == F.col(f"hot_{k}") if k == keys[0] else same & (rows[k] == F.col(f"hot_{k}"))
    rows = rows.join(F.broadcast(hot), same, "left")
    # Rows that are done are spread; what they might hit by chance is not taken.
    done = F.col(f"hot_{keys[0]}").isNotNull()
    rows = rows.withColumn("spread", F.when(done, F.xxhash64(*names)).otherwise(F.col(keys[0])))
    same = F.col("spread") == F.col(f"known_{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"known_{k}"))
    rows = rows.join(rest, same, "left")
    return rows.select(*names, *[F.when(done, F.col(f"hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def shuffle_width(spark: SparkSession, docs: DataFrame, text: str, mb: int) -> int:
    """Partitions for work on whole texts: the session's setting, or more at over ``mb`` MB of text each."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))
