"""Type names of each kind of source, as Spark types. The maps differ, so each source has its own."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import types as T

from quillon.config import ColumnConfig
from quillon.errors import Code, make

_INT, _LONG, _STR, _DBL, _BOOL = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
_YAML = {"int": _INT, "integer": _INT, "bigint": _LONG, "varchar": _STR, "string": _STR, "text": _STR, "char": _STR, "float": _DBL, "double": _DBL, "boolean": _BOOL, "bool": _BOOL, "date": T.DateType(), "decimal": T.DecimalType(15, 2)}
_POSTGRES = {"smallint": T.ShortType(), "int2": T.ShortType(), "integer": _INT, "int4": _INT, "bigint": _LONG, "int8": _LONG, "real": T.FloatType(), "float4": T.FloatType(), "double precision": _DBL, "float8": _DBL, "numeric": _DBL, "decimal": _DBL, "boolean": _BOOL, "bool": _BOOL, "date": T.DateType()}
_DUCKDB = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": _INT, "BIGINT": _LONG, "UTINYINT": T.ShortType(), "USMALLINT": _INT, "UINTEGER": _LONG, "UBIGINT": T.DecimalType(20, 0), "HUGEINT": T.DecimalType(38, 0), "FLOAT": T.FloatType(), "DOUBLE": _DBL, "BOOLEAN": _BOOL, "VARCHAR": _STR, "DATE": T.DateType(), "BLOB": T.BinaryType()}


def from_yaml(name: str) -> T.DataType:
    """Declared column types; a decimal is (15, 2) unless it says otherwise, an unknown name is a string."""
    m = re.fullmatch(r"\s*decimal\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*", name, re.I)
    return T.DecimalType(int(m[1]), int(m[2])) if m else _YAML.get(name.strip().lower(), _STR)


def from_postgres(name: str) -> T.DataType:
    n = name.strip().lower()
    if n.startswith("timestamp"):
        return T.TimestampNTZType()
    return _POSTGRES.get(n.split("(")[0].strip(), _STR)


def from_sqlite(name: str) -> T.DataType:
    """By affinity: INT, then CHAR/CLOB/TEXT, then REAL/FLOA/DOUB, else text."""
    n = (name or "").upper()
    if "INT" in n:
        return _LONG
    if any(x in n for x in ("CHAR", "CLOB", "TEXT")):
        return _STR
    return _DBL if any(x in n for x in ("REAL", "FLOA", "DOUB")) else _STR


def from_duckdb(name: str) -> T.DataType:
    n = name.strip().upper()
    if n.startswith("TIMESTAMP"):
        return T.TimestampNTZType()
    m = re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", n)
    return T.DecimalType(int(m[1]), int(m[2])) if m else _DBL if n == "DECIMAL" else _DUCKDB.get(n, _STR)


def from_grpc(name: str) -> T.DataType:
    kinds = {"Utf8": _STR, "Int64": _LONG, "Float64": _DBL, "Boolean": _BOOL}
    if name not in kinds:
        raise make(Code.CONFIG_ERROR, f"unsupported column type {name!r}", expected=list(kinds))
    return kinds[name]


def infer_json(record: dict[str, Any]) -> T.StructType:
    """Schema of a REST source from its first record; nested values and nulls become strings."""

    def kind(v: Any) -> T.DataType:
        return _BOOL if isinstance(v, bool) else _LONG if isinstance(v, int) else _DBL if isinstance(v, float) else _STR

    return T.StructType([T.StructField(k, kind(v), True) for k, v in record.items()])


def declared(columns: list[ColumnConfig], mapper=from_yaml) -> T.StructType | None:
    """The schema that a table's columns declare, with their facts as field metadata."""
    out = []
    for c in columns:
        facts = {k: v for k, v in (("length", c.length), ("comment", c.comment), ("primary_key", c.primary_key or None), ("unique", c.unique or None)) if v is not None}
        out.append(T.StructField(c.name, mapper(c.type), not c.not_null, facts))
    return T.StructType(out) if out else None
