"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import ensure_checkpoint_dir

#: ASCII white space, which separates words (fixed by the contracts)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: while a table is written: its shuffle files go when it is done, and batches sent to Python stay small
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it
    back: lineage is cut once and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}_{uuid.uuid4().hex[:16]}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm/" in path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"_{n}"
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out
