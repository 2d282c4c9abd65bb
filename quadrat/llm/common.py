"""What the operators share: reading, writing intermediate tables, and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.session import shared_path

#: White space that separates words, as a Java regular expression (fixed by the contract).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one or two numbers that are broadcast at most (16 bytes each); they are counted before.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    The files survive lost executors. They go with ``freed`` once what was made of them is stored itself; the
    rest of the folder belongs to the cluster (``spark.checkpoint.dir``), whose owner clears it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the decimal digits of the id, modulo a number."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones which no column has, whatever the case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def appended(df: DataFrame, make: Callable, schema: str, uses: Sequence[str], drop: Sequence[str] = (),
             rows: int = 256) -> DataFrame:
    """Append columns made by ``make``, which gets the used columns as Arrow arrays of at most ``rows`` rows.

    It returns one list or array per column of ``schema``. The other columns pass untouched.
    """
    new = T._parse_datatype_string(schema).fields
    at = [df.columns.index(c) for c in uses]
    stay = [i for i, c in enumerate(df.columns) if c not in drop]
    out = T.StructType([df.schema.fields[i] for i in stay] + new)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    names = [f.name for f in out.fields]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                made = make(*[part.column(i) for i in at])
                extra = [
                    pa.array(x, kinds[f.dataType.simpleString()], from_pandas=True) for x, f in zip(made, new, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in stay] + extra, names)

    return df.mapInArrow(run, out)
