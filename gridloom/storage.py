"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side may be broadcast if it has at most so many rows and bytes, both measured; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only where none is set and all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file:///tmp/gridloom-checkpoints"
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends, or with the scratch() it was made in."""
    path = f"{scratch_root(spark)}/gridloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    target, store = _file_system(spark, path)
    store.deleteOnExit(target)
    if (written := _written.get()) is not None:
        written.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, all tables of cut() are scratch: they are deleted at the end, unless keep() named them."""
    outer, mine = _written.get(), []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for path in mine:
            if path in _kept:
                _kept.discard(path)
                if outer is not None:
                    outer.append(path)
            else:
                target, store = _file_system(spark, path)
                store.delete(target, True)


_kept: set[str] = set()


def cut(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back; a lost executor costs no recomputation before it.

    kept: the table outlives the scratch() it is made in.
    """
    path = scratch_path(df.sparkSession, name)
    if kept:
        _kept.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of cut() at the end of the present scratch(), which must write what replaces it."""
    path, written = getattr(df, "_scratch_path", None), _written.get()
    if path and written is not None:
        written.append(path)


def width(value: Column, kind: DataType) -> Column | int:
    """Bytes of a value, about: a number if they are the same in all rows."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return 8 + sum(width(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        inner = width(value, kind.elementType)
        if isinstance(inner, int):
            return F.coalesce(F.greatest(F.size(value), F.lit(0)).cast("long"), F.lit(0)) * inner + 16
        total = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.lit(width(x, kind.elementType)).cast("long"), F.lit(0)))
        return F.coalesce(total, F.lit(0)) + 16
    if isinstance(kind, MapType):
        return width(F.map_keys(value), ArrayType(kind.keyType)) + width(F.map_values(value), ArrayType(kind.valueType))
    return 8


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows and bytes are within the bounds.

    Rows are counted here unless given (an upper bound will do); bytes are summed unless all rows have the same.
    """
    each = 16 + sum(width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields)
    if rows is None or (rows <= BROADCAST_ROWS and not isinstance(each, int)):
        rows, size = df.agg(F.count("*"), F.sum(each if not isinstance(each, int) else F.lit(each))).first()
    else:
        size = rows * each if isinstance(each, int) else 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df
