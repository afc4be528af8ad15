"""Helpers that several operators share: the shared folder, Arrow batches, hashing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.plans.storage import cut, shared_dir  # noqa: F401

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}


def batches(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; made without a session, so that executors can."""
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def record_batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(parts, rows: int = 256):
    """The batches in short slices, so that the Python objects of a few rows are held at a time."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def lower_ascii(column):
    """A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
