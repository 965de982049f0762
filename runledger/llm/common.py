"""Helpers shared by the operators: free column names, slices of Arrow batches, words as bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import types as T

#: A-Z become a-z; every other ASCII character that is no letter and no digit becomes a space; bytes of longer characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until it clashes with no column (upper and lower case are alike in Spark)."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of a few rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def schema(df, kept: list[str], added: str) -> T.StructType:
    """The kept columns of df, then the added ones."""
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *T.StructType.fromDDL(added).fields])


def arrow_schema(spark_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)
