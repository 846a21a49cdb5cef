"""Scanning of results: hostile instructions for agents, and personal data for logs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.adapters import quoted
from quillon.errors import Code, make

#: The phrases that are looked for, whatever their case.
PATTERNS = (
    "ignore previous instructions",
    "disregard previous instructions",
    "system prompt",
    "developer message",
    "BEGIN SYSTEM PROMPT",
    "BEGIN DEVELOPER MESSAGE",
    "you are chatgpt",
)
#: Only so many bytes at the front of each cell are scanned.
CELL_BYTES = 8192
MODES = ("disabled", "dry_run", "enforce")


def within_bytes(column: Column, most: int = CELL_BYTES) -> Column:
    """The cell's first ``most`` bytes as text; a character cut in two at the end does not matter to a search."""
    return F.when(F.octet_length(column) <= most, column).otherwise(F.substring(F.encode(column, "UTF-8"), 1, most).cast("string"))


def suspicious(column: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """The first pattern in the cell's front, or null. Case does not matter."""
    front, found = F.lower(within_bytes(column)), F
    for p in patterns:
        found = found.when(F.contains(front, F.lit(p.lower())), F.lit(p))
    return found


def scan(df: DataFrame) -> DataFrame:
    """(column, pattern, n): how many cells of each string column hold each pattern."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, pattern string, n long")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(quoted(n)).alias("v")) for n in names])).alias("c")).where("c.v is not null")
    front = F.lower(within_bytes(F.col("c.v")))
    hits = F.array(*[F.when(F.contains(front, F.lit(p.lower())), F.lit(p)) for p in PATTERNS])
    found = rows.select("c.column", F.explode(F.filter(hits, lambda p: p.isNotNull())).alias("pattern"))
    return found.groupBy("column", "pattern").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Finding:
    column: str
    pattern: str


def scan_arrow(table, patterns: tuple[str, ...] = PATTERNS) -> list[Finding]:
    """First finding of each column of a result that is already here."""
    import pyarrow as pa
    import pyarrow.compute as pc

    one = re.compile("|".join(re.escape(p) for p in patterns), re.I)
    out = []
    for name in table.column_names:
        values = table.column(name)
        kind = values.type.value_type if pa.types.is_dictionary(values.type) else values.type
        if not (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
            continue
        for v in pc.unique(values.cast(pa.large_string())).to_pylist():
            m = v and one.search(v.encode()[:CELL_BYTES].decode("utf-8", "ignore"))
            if m:
                out.append(Finding(name, next(p for p in patterns if p.lower() == m[0].lower())))
                break
    return out


def guard(table, mode: str = "disabled") -> list[str]:
    """Warnings in dry_run; an error in enforce."""
    if mode not in MODES:
        raise make(Code.CONFIG_ERROR, f"unknown guard mode '{mode}'", modes=MODES)
    found = scan_arrow(table) if mode != "disabled" else []
    if found and mode == "enforce":
        raise make(Code.PROMPT_INJECTION, f"pattern '{found[0].pattern}' in column '{found[0].column}'", findings=[vars(f) for f in found])
    return [f"[{Code.PROMPT_INJECTION.label}] Pattern '{f.pattern}' found in column '{f.column}'" for f in found]


#: What is scrubbed, in this order.
SCRUB = (
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d[ -]*?){13,16}\b", "[CREDIT_CARD]"),
    (r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}", "[PHONE]"),
)


def scrub(text: str) -> str:
    for pattern, name in SCRUB:
        text = re.sub(pattern, name, text, flags=re.ASCII)
    return text


def scrub_column(column: Column) -> Column:
    """The same as a column; texts without @ or digits pass the costlier patterns by."""
    mail, *digits = SCRUB
    out = F.when(F.contains(column, F.lit("@")), F.regexp_replace(column, *mail)).otherwise(column)
    made = out
    for pattern, name in digits:
        made = F.regexp_replace(made, pattern, name.replace("$", r"\$"))
    return F.when(out.rlike("[0-9]"), made).otherwise(out)
