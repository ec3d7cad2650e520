"""Pieces shared by the corpus operators.

A document row is identified by ``(doc_id, text)``: joins back to documents use ``doc_id`` and
``text_hash`` together, so repeated ids with different texts stay apart and repeated rows act alike.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a null ``doc_id`` inside joins and groupings.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (null as NO_ID), text (null as empty), text_hash."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))


def real_id(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df has not: helper columns never stand in for one of the user's."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, stem: str = "key") -> tuple[DataFrame, str]:
    """docs with one more column, of a fresh name: struct(doc_id, text_hash) as in ``identified``."""
    name = fresh(docs, stem)
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    return docs.withColumn(name, key), name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without one: it gets a temporary folder."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Folders of stored tables by the scratch blocks that are open, innermost last.
_open: list[list[str]] = []


def _written(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    table, path = _written(df, compression)
    if _open:
        _open[-1].append(path)
    return table


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, the tables stored inside, but for those that went through the function it gives; these belong to the block around it."""
    _open.append([])

    def keep(df: DataFrame) -> DataFrame:
        table, path = _written(df)
        if len(_open) > 1:
            _open[-2].append(path)
        return table

    try:
        yield keep
    finally:
        for path in _open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        spark._jvm.System.gc()  # Spark drops the shuffle files of tables that nothing refers to any more
