"""Small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing document id, so that such rows still group and sort (first).
NO_ID = -(2**63)

#: Byte table: A-Z become a-z; what separates words becomes a blank. Bytes from 0x80 on belong to words.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, k: int) -> Column:
    """crc32 of the id's text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share. Where none is set, one is made here for a local master
    (tests); on a cluster that would be a folder of one machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder and read again: their lineage ends here, and lost executors don't matter."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What make() gave for this key, kept in the Python worker until another key is asked for: workers serve many
    stages, and their tables shall not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: Rows that go to a Python worker at once, unless the session says otherwise: texts can be long.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; has the session send them to Python workers in small batches, where it has the default size."""
    if df.sparkSession.conf.get(_BATCHES) == "10000":
        df.sparkSession.conf.set(_BATCHES, str(BATCH_ROWS))
    return df


def map_arrow(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, *, keep: list[str] | None = None
) -> DataFrame:
    """Each task calls make() once and passes its Arrow batches through what that returns (columns by name).

    With `keep`, which needs a row out for each row in, these columns of `df` come first, under their names.
    """
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]
    types = _arrow_types(schema)
    kept = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                made = [pa.array(out[n], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=[*kept, *names])

    whole = StructType([*(df.schema[k] for k in kept), *StructType.fromDDL(schema)])
    return small_batches(df).mapInArrow(run, whole)


def _arrow_types(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
