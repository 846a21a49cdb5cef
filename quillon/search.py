"""Search over schemas: BM25 on table, column, type and the front of the description."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from quillon.catalog import Catalog

DESCRIPTION, LIMIT, COVERAGE = 100, 5, 0.20


@dataclass(frozen=True)
class Hit:
    schema: str
    table: str
    column: str
    score: float


class SchemaIndex:
    """An index over a catalog's columns: metadata, whose size is that of the schemas, not of the data."""

    def __init__(self, catalog: Catalog):
        self.rows = [(r["table_schema"], r["table_name"], r["column_name"], f"{r['table_name']} {r['column_name']} {r['data_type']} {(r['comment'] or '')[:DESCRIPTION]}", bool(r["comment"])) for r in catalog.information_columns().collect()]
        self.bags = [Counter(self.words(text)) for *_, text, _ in self.rows]
        self.df = Counter(w for b in self.bags for w in b)
        self.mean = sum(sum(b.values()) for b in self.bags) / max(1, len(self.bags))

    @staticmethod
    def words(text: str) -> list[str]:
        return re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).replace("_", " ").lower())

    def coverage(self) -> float:
        """Share of columns that have a description; below 0.20, enrich before relying on the search."""
        return sum(x for *_, x in self.rows) / len(self.rows) if self.rows else 0.0

    def search(self, text: str, limit: int = LIMIT, schema: str | None = None) -> list[Hit]:
        asked, out, n = self.words(text), [], len(self.rows)
        for (s, t, c, _, _), bag in zip(self.rows, self.bags, strict=True):
            if schema and s != schema:
                continue
            size = sum(bag.values())
            score = sum(math.log(1 + (n - self.df[w] + 0.5) / (self.df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / self.mean)) for w in asked if w in bag)
            if score > 0:
                out.append(Hit(s, t, c, score))
        return sorted(out, key=lambda h: (-h.score, h.schema, h.table, h.column))[:limit]


def schema_details(catalog: Catalog, table: str) -> list[dict]:
    found = catalog.find(table.split("."))
    if found is None:
        return []
    t = catalog.tables[found]
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "comment": f.metadata.get("comment")} for f in t.declared or t.load().schema]
