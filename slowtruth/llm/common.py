"""Helpers of the training-data operators: columns by position, Arrow batches, hashes.

Operators read the columns they need by name and carry all others along untouched. A name matches
exactly, else without regard to case; of several matches the first counts. Output columns win over
input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema  # noqa: F401

#: ASCII white space, as in the pattern [\x20\x09-\x0D]; bytes.split() and bytes.strip() use the same set.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that are opened as Python objects at once.
PART_ROWS = 256


def position(df: DataFrame, name: str) -> int:
    """Where the column stands; exact name first, then without case."""
    names = df.columns
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``new=old``; safe when other columns clash with each other or with these."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"_{position(df, old)}"].alias(new) for new, old in columns.items()])


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns ``_0``, ``_1`` ..., which no operator's own names clash with."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def restored(df: DataFrame, names: list[str], new: Iterable[str], replaced: Iterable[str] = ()) -> DataFrame:
    """Back from ``numbered``: input columns under their names, without those that ``new`` columns replace."""
    new = list(new)
    gone = {n.lower() for n in new}
    keep = [df[f"_{i}"].alias(n) for i, n in enumerate(names) if n.lower() not in gone]
    return df.select(*keep, *[df[n] for n in new])


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that only a slice's texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[..., list], fields: list[tuple[str, str]]
) -> DataFrame:
    """Append columns that ``fn`` computes from Python lists of some columns, batch by batch.

    All other columns pass through as Arrow arrays, without being turned into Python objects.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    added = to_arrow_schema(T.StructType(schema.fields[len(df.columns):]))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            out = fn(*[batch.column(c).to_pylist() for c in columns])
            arrays = [pa.array(values, type=field.type) for values, field in zip(out, added)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=names)

    return df.mapInArrow(run, schema)


def hash128(column: Column) -> Column:
    """A 128-bit hash as two longs, from two seeds of one hash function."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit("second"), column).alias("b"))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def ascii_lower_sql(text: str) -> str:
    """DuckDB: A-Z lower-cased, all else as it is."""
    return f"translate({text}, '{UPPER}', '{LOWER}')"
