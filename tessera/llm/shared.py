"""Session helpers that all corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Place of the public tokenizer files; a parameter of every tokenizer operator.
PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the cluster names none (tests in local mode) a folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are in the shared folder, lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, read back."""
    return stored(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}", codec)


def stored(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """The rows as a compressed Parquet table at a path, read back."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over whole batches: rows() gets dicts of column lists and yields the same."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in rows({name: b.column(name).to_pylist() for name in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def document_order(column: str = "doc_id") -> list:
    return [F.col(column).asc_nulls_first()]


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished jobs: Spark drops them when neither Python nor the driver's JVM hold their frames."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder in the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A path in the shared folder that is removed at the end, whatever happens."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)
