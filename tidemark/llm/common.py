"""What the corpus operators share: table access, lineage cuts and batch helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shipping import ship


#: Tables that :func:`cut` has written in this process and that nobody has dropped.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only on a local master that sets none, as in tests."""
    sc = spark.sparkContext._jsc.sc()
    found = sc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(path)
    return sc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point from which :func:`drop` counts."""
    return len(_written)


def drop(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables written since a :func:`mark`, but for those that ``keep`` reads.

    Without ``since``: all of this process; call it when the results have been written.
    """
    read = "\n".join(file for df in keep for file in df.inputFiles())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in [path for path in _written[since:] if path.rpartition("/")[2] not in read]:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, for columns that an operator adds and takes away again."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, at least a row each: bounds the temporaries of vectorised code."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
