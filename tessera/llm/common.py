"""What the operators of this subpackage share: tables kept in the cluster's shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import fresh_path, remove, shared_dir, stored, stored_at

__all__ = ["fresh_path", "remove", "shared_dir", "stored", "stored_at"]


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` hasn't, in any spelling of capitals."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wish}"
    while name in taken:
        name += "_"
    return name


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """What a worker process keeps between its tasks, such as a tokenizer and the words it remembers: one thing at a time, for
    workers outlive a stage; when another one is asked for, the one before goes."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on the session hands Python workers batches of about ``most`` bytes, if it handed them larger ones, so that long texts take little memory at once.

    Spark reads the setting when a frame runs, so it stays as it is set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        spark.conf.set(name, f"{most}b")


def add_in_arrow(df: DataFrame, given: str, made: dict[str, T.DataType], work: Callable[[pa.Array], list[pa.Array]], *, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the columns ``made``, which ``work`` makes of each batch's column ``given``; columns of those names are replaced, all others pass, whatever their names, but for those in ``drop``.

    A column that passes is sent to the workers once, ``given`` too.
    """
    small_batches(df.sparkSession)
    passing = [c for c in df.columns if c not in made and c not in drop]
    row = F.struct(*[F.col(f"`{c}`") for c in passing]) if passing else F.struct(F.lit(0))
    place = passing.index(given) if given in passing else None
    packed = df.select(row.alias("row")) if place is not None else df.select(row.alias("row"), F.col(f"`{given}`").alias("given"))
    names = [f"made{i}" for i in range(len(made))]
    schema = T.StructType([packed.schema["row"], *(T.StructField(n, t) for n, t in zip(names, made.values(), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row")
            yield pa.RecordBatch.from_arrays([rows, *work(b.column("given") if place is None else rows.field(place))], names=["row", *names])

    found = packed.mapInArrow(run, schema)
    return found.select(*(["row.*"] if passing else []), *(F.col(n).alias(m) for n, m in zip(names, made, strict=True)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark would read it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bytes_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
