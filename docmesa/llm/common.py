"""What the operators of this folder share: table access, shared storage, shipping code to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch sent to Python; long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_shipped: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and sends this package to the executors, once a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "docmesa_llm.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("docmesa", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share. Where it is unset, as in tests, a temporary
    one if all is one machine; on a cluster that is an error, for executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docmesa-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor loses nothing."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that were written and are not referred to any more; else they
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a worker has freed back to the system. Workers live on from stage to stage, and what one stage held would else
    count beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(df: DataFrame, change: Callable[[list[str | None]], list[str | None]], text_col: str = "text") -> DataFrame:
    """df with its texts changed batch by batch; a row whose text becomes null goes, unless it was null before. n_chars, if there, follows."""
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            old = b.column(at).to_pylist()
            new = change(old)
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([c if t == o else len(t or "") for c, t, o in zip(b.column(k).to_pylist(), new, old, strict=True)], b.schema.field(k).type)
            out = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield out.filter(pa.array([t is not None or o is None for t, o in zip(new, old, strict=True)], pa.bool_()))

    return df.mapInArrow(rows, df.schema)
