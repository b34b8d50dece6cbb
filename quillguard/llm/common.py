"""What the training-data operators share: reading tables, Arrow maps over whole texts, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
STEP_BYTES = 4 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Workers also get this repository on their path, for sessions started elsewhere."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset a session on one machine, as in tests, gets a
    local one; on a cluster that would be each executor's own disk, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillguard-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is read column by column.

    by: a column whose values become folders, so that a filter on it reads only those.
    """
    path = f"{shared_dir(df.sparkSession)}/quillguard/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The column that carries a row's kept columns, as a struct, through an operator.
KEPT = "__kept"


def carried(df: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """KEPT and the named columns. Operators work on these, so no name of theirs can meet a column of the row."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias(KEPT), *(c.alias(n) for n, c in more.items()))


def restored(df: DataFrame, results: list[str]) -> DataFrame:
    """The kept columns, with their names and values, then the results. A result whose name a kept column has gets
    underscores behind it until the name is free."""
    keep = df.schema[KEPT].dataType.names
    taken, named = {c.lower() for c in keep}, []
    for r in results:
        name = r
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        named.append(F.col(r).alias(name))
    return df.select(*(F.col(KEPT).getField(c).alias(c) for c in keep), *named)


def fold_of(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of doc_id as text, modulo parts. A null doc_id counts as the text ''."""
    as_text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit("")).cast("binary")) % parts


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def pieces_of(batch: pa.RecordBatch, at: int, rows: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and at most so many bytes in column `at` unless one row holds more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start == rows or held + n > most):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable], adds: str, keep: list[str], text: str = "text", step: int = 256) -> DataFrame:
    """Adds columns computed from whole texts, Arrow batch by Arrow batch, without a shuffle.

    make() is called once a task and gives a function from a list of texts (null: '') to the columns named in the
    DDL string adds, in order. Texts are handed over at most step, and at most STEP_BYTES of them (or one longer text),
    at a time, so memory stays bounded.
    keep: columns passed through, none named as an added one (operators keep KEPT); other columns aren't read.
    """
    added = T._parse_datatype_string(adds)
    schema = T.StructType([*(df.schema[c] for c in keep), *added.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]
    names = [*keep, *(n for n, _ in kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces_of(batch, len(keep), step):
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                new = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == k else pa.array(c, type=k) for c, (_, k) in zip(work(texts), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=names)

    return df.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def collect_blocks(df: DataFrame, make: Callable[[], tuple[Callable, Callable]], schema: str, text: str) -> DataFrame:
    """One partial summary a task: make() gives (add(texts), finish() -> iterator of lists of columns)."""
    out = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = make()
        for batch in batches:
            for part in pieces_of(batch, 0, 256):
                add(part.column(0).to_pylist())
        for columns in finish():
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == k else pa.array(c, type=k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return df.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, out)
