"""What the corpus operators share: reading tables, bounded Arrow batches, shared scratch space."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches sent to Python hold at most so many rows and bytes, so that a run of very long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; let workers import the package where their path lacks it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    here = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    if ROOT not in {os.path.realpath(p) for p in here} and not (Path(os.getcwd()) / "supplymesh").exists():
        ship(spark)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once a session."""
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_supplymesh_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        with zipfile.ZipFile(f"{folder}/supplymesh.zip", "w") as z:
            for p in sorted(Path(ROOT, "supplymesh").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(f"{folder}/supplymesh.zip")
    sc._supplymesh_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode uses a folder under /tmp, and a cluster is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = found or "/tmp/checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; when its input ends, the worker gives back what memory it holds but doesn't use, as it lives on for other tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def schema_with(df: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """df's schema and further nullable columns (name, type), as a new schema."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in added)])


def spare(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written once to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_remainder(column: str, modulus: int):
    """crc32 of the column as text, modulo a number; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(column: str, share, seed: int):
    """Whether a row is in a sample of about this share (a number or column), by a hash of the column: the same rows every time."""
    bits = 1 << 30
    return F.pmod(F.xxhash64(F.col(f"`{column}`"), F.lit(seed)), F.lit(bits)) < (share if isinstance(share, Column) else F.lit(float(share))) * bits
