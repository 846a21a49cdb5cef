"""Names: source tables as views, information_schema, three-part names, LIKE search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.compat import tokens
from quillon.sources.base import Table


def view_name(schema: str, table: str) -> str:
    """The temp view of a table; public tables are found by their bare name as well."""
    return table if schema == "public" else f"{schema}__{table}"


class Catalog:
    """Registered tables by (schema, name)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tables, self.source_of = spark, name, {}, {}
        self.errors: dict[str, Exception] = {}

    def add(self, source: str, table: Table) -> None:
        self.tables[(table.schema, table.name)] = table
        self.source_of[(table.schema, table.name)] = source

    def names(self) -> list[str]:
        return sorted({t for _, t in self.tables} | {f"{s}.{t}" for s, t in self.tables})

    def find(self, parts: list[str]) -> tuple[str, str] | None:
        """(schema, table) of a name of one to four parts, case aside."""
        low = [p.lower() for p in parts]
        if len(low) > 2 and low[0] == self.name.lower():
            low = low[1:]
        for schema, table in self.tables:
            if low[-1] != table.lower():
                continue
            source = self.source_of[(schema, table)].lower()
            if len(low) == 1 and (schema == "public" or sum(t.lower() == low[-1] for _, t in self.tables) == 1):
                return schema, table
            if len(low) == 2 and low[0] in (schema.lower(), source) or len(low) == 3 and low[:2] in ([source, schema.lower()], [source, "public"], [source, "main"]):
                return schema, table
        return None

    def rewrite(self, sql: str, prefix: str = "") -> tuple[str, list[tuple[str, str]]]:
        """``sql`` with dotted names of registered tables as view names, and the tables that it reads.

        A name counts where a table may stand: after FROM, JOIN or a comma of a FROM list.
        """
        ts, out, used = tokens(sql), [], []
        i, expecting = 0, False
        depth_from: list[int] = []
        depth = 0
        while i < len(ts):
            t = ts[i]
            if t.isspace() or t.startswith(("--", "/*")):
                out.append(t)
                i += 1
                continue
            up = t.upper()
            if t == "(":
                depth += 1
            elif t == ")":
                depth -= 1
                while depth_from and depth_from[-1] > depth:
                    depth_from.pop()
            if up in ("FROM", "JOIN"):
                expecting = True
                if up == "FROM":
                    depth_from.append(depth)
            elif up in ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "SELECT", "WINDOW", "QUALIFY", "ON"):
                if depth_from and depth_from[-1] == depth and up != "ON":
                    depth_from.pop()
                expecting = False
            elif t == "," and depth_from and depth_from[-1] == depth:
                expecting = True
            elif expecting and (re.match(r"[A-Za-z_]", t) or t[0] in '`"'):
                parts, j = [t], i + 1
                while j + 1 < len(ts) and ts[j] == "." and (re.match(r"[A-Za-z_]", ts[j + 1]) or ts[j + 1][0] in '`"'):
                    parts.append(ts[j + 1])
                    j += 2
                plain = [p.strip('`"') for p in parts]
                found = self.find(plain)
                expecting = False
                if found:
                    used.append(found)
                    alias = "" if self._aliased(ts, j) else f" AS `{found[1]}`"
                    out.append(f"`{prefix}{view_name(*found)}`{alias}")
                    i = j
                    continue
                if plain[0].lower() == "information_schema" and len(plain) == 2:
                    out.append(f"`information_schema__{plain[1].lower()}`")
                    i = j
                    continue
            else:
                expecting = False
            out.append(t)
            i += 1
        return "".join(out), list(dict.fromkeys(used))

    @staticmethod
    def _aliased(ts: list[str], j: int) -> bool:
        """Does an alias (or a clause that forbids one) follow?"""
        rest = [t for t in ts[j:] if not t.isspace()]
        if not rest:
            return False
        up = rest[0].upper()
        stops = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "QUALIFY", "WINDOW", "LATERAL", "SEMI", "ANTI", ")", ",", ";"}
        return up not in stops

    def information_tables(self) -> DataFrame:
        rows = [(self.name, s, t, "VIEW", self.source_of[(s, t)], x.comment) for (s, t), x in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string, source string, comment string")

    def information_columns(self) -> DataFrame:
        rows = []
        for (s, t), x in sorted(self.tables.items()):
            for i, f in enumerate(x.declared or x.load().schema, 1):
                rows.append((self.name, s, t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO", f.metadata.get("comment")))
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, comment string")

    def tables_like(self, schema: str | None = None, table: str | None = None) -> DataFrame:
        """Tables by SQL LIKE patterns, as metadata clients ask for them."""
        out = self.information_tables()
        if schema is not None:
            out = out.where(F.col("table_schema").like(schema))
        return out.where(F.col("table_name").like(table)) if table is not None else out
