"""What the corpus operators share: words, row keys and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_ASCII_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset, a temporary one, on a single machine only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", where)
    return where


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `new_path` and `written` made within; for jobs whose result is written by then, elsewhere."""
    before = _scratch.set([])
    try:
        yield
    finally:
        made = _scratch.get()
        _scratch.reset(before)
        for x in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors.

    The table stands as long as results may be read from it; `scratch` deletes those that a job made.
    """
    return written_at(df, new_path(df.sparkSession, name))


def own_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters are in their names."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns]


def words_of(text: Column) -> Column:
    """Array of a text's words (null or blank text: empty array), by built-in functions only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes of a narrow table that may be sent to all tasks; beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows and bytes are few enough; df should be cheap to read."""
    fixed = 16 + 8 * len(df.columns)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum(texts, F.lit(fixed))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0)) if texts else F.count("*") * fixed).first()
    return F.broadcast(df) if n <= rows and total <= size else df


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """text with the letters A-Z in lower case."""
    return F.translate(text, _UPPER, _UPPER.lower())
