"""Permissions, row filters, column masks and data contracts, as rewrites of the frames users see."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.adapters import quoted
from quillon.config import Contract
from quillon.errors import Code, make
from quillon.types import from_yaml


@dataclass(frozen=True)
class Mask:
    """redact, hash, keep_first(n), default(value), or custom (a SQL expression)."""

    kind: str
    value: Any = None

    def column(self, name: str) -> Column:
        c = F.col(quoted(name))
        if self.kind == "redact":
            return F.when(c.isNotNull(), F.lit("***"))
        if self.kind == "hash":
            return F.sha2(c.cast("string"), 256)
        if self.kind == "keep_first":
            s, n = c.cast("string"), int(self.value)
            return F.rpad(F.substring(s, 1, n), F.length(s), "*") if n else F.repeat(F.lit("*"), F.length(s))
        if self.kind == "default":
            return F.lit(self.value)
        if self.kind == "custom":
            return F.expr(self.value)
        raise make(Code.CONFIG_ERROR, f"unknown mask '{self.kind}'")

    @staticmethod
    def parse(raw: Any) -> Mask:
        if isinstance(raw, dict):
            kind, value = next(iter(raw.items()))
            return Mask(kind.lower(), value)
        name = str(raw).strip()
        m = re.fullmatch(r"(?i)keep_?first\((\d+)\)", name)
        return Mask("keep_first", int(m[1])) if m else Mask({"mask": "redact"}.get(name.lower(), name.lower()))


@dataclass
class TableRule:
    """What a user may see of a table: rows for which ``rls`` holds, columns through their masks."""

    rls: str | None = None
    masks: dict[str, Mask] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """The filter reads true values; everything above it, user predicates included, reads masked ones."""
        if self.rls:
            df = df.where(F.expr(self.rls))
        if not self.masks:
            return df
        return df.select(*[self.masks[c].column(c).alias(c) if c in self.masks else F.col(quoted(c)) for c in df.columns])

    def __and__(self, other: TableRule) -> TableRule:
        """Both rules at once: rows that pass both, columns masked by either."""
        rls = " AND ".join(f"({r})" for r in (self.rls, other.rls) if r) or None
        return TableRule(rls, {**other.masks, **self.masks})


@dataclass
class User:
    id: str = "anonymous"
    permissions: frozenset[str] = frozenset()
    rules: dict[str, TableRule] = field(default_factory=dict)

    def can(self, permission: str) -> bool:
        """admin and * may do all; ``prefix:*`` covers what starts with ``prefix:``, not ``prefix`` itself."""
        if self.permissions & {"admin", "*", permission}:
            return True
        return any(p.endswith(":*") and permission.startswith(p[:-1]) for p in self.permissions)

    def require(self, permission: str) -> None:
        if not self.can(permission):
            raise make(Code.AUTHORIZATION_DENIED, f"user '{self.id}' lacks '{permission}'")

    def rule_for(self, schema: str, table: str) -> TableRule | None:
        if self.can("admin"):
            return None
        found = None
        for name, rule in self.rules.items():
            if name == "*" or name.split(".")[-1] == table and (len(p := name.split(".")) < 2 or p[-2] in (schema, "public")):
                found = rule if found is None else found & rule
        return found


def load_policies(raw: dict) -> dict[str, User]:
    """Users of a policies file: roles grant rules by resource; a rule-free ``*`` grant is admin's."""
    roles = {r["name"]: r.get("policies", []) for r in raw.get("roles", [])}
    out = {}
    for u in raw.get("users", []):
        rules, permissions = {}, set()
        for role in u.get("roles", []):
            permissions.add(f"role:{role}")
            if role not in roles:
                raise make(Code.CONFIG_ERROR, f"user '{u['id']}' has an unknown role '{role}'")
            for p in roles[role]:
                rule = TableRule(p.get("rls_filter"), {c: Mask.parse(m) for c, m in (p.get("masking") or {}).items()})
                if p["resource"] == "*" and not rule.rls and not rule.masks:
                    permissions.add("admin")
                else:
                    rules[p["resource"]] = rules[p["resource"]] & rule if p["resource"] in rules else rule
        out[u["id"]] = User(u["id"], frozenset(permissions), rules)
    return out


# Contracts ----------------------------------------------------------------------------------


def constraint_column(name: str, kind: str, value: Any) -> Column:
    """Holds where the value meets the constraint; a null meets every constraint but not_null."""
    c = F.col(quoted(name))
    if kind == "not_null":
        return c.isNotNull()
    tests = {"gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value, "eq": lambda: c == value, "between": lambda: c.between(value["min"], value["max"]), "in": lambda: c.isin(list(value)), "regex": lambda: c.cast("string").rlike(value), "length": lambda: F.length(c) <= int(value)}
    if kind not in tests:
        raise make(Code.CONFIG_ERROR, f"unknown constraint '{kind}'", known=sorted(tests))
    return c.isNull() | tests[kind]()


def _family(kind: str) -> str:
    return "number" if re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", kind) else "time" if re.match(r"(date|timestamp)", kind) else kind


def schema_violations(df: DataFrame, contract: Contract) -> list[str]:
    """Missing columns, types of another family, and in a strict contract columns beyond it."""
    out, have = [], {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in contract.columns:
        if c.name not in have:
            out.append(f"missing column '{c.name}'")
        elif _family(have[c.name]) != _family(from_yaml(c.type).simpleString()):
            out.append(f"column '{c.name}' is {have[c.name]}, the contract says {c.type}")
    if contract.strict:
        out += [f"column '{n}' is not in the contract" for n in have if n not in {c.name for c in contract.columns}]
    return out


def _rules(df: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    return [(c.name, k.type, constraint_column(c.name, k.type, k.value)) for c in contract.columns if c.name in df.columns for k in [*c.constraints, *([] if c.nullable else [type("Constraint", (), {"type": "not_null", "value": None})])]]


def contract_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that meet every constraint."""
    for _, _, ok in _rules(df, contract):
        df = df.where(ok)
    return df


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(column, constraint, violations): one pass, one row a constraint."""
    rules = _rules(df, contract)
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, constraint string, violations long")
    counts = df.agg(*[F.count(F.when(~ok, 1)).alias(f"v{i}") for i, (_, _, ok) in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("constraint"), F.col(f"v{i}").alias("violations")) for i, (c, k, _) in enumerate(rules)])
    return counts.select(F.inline(cells))


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` if its schema keeps the contract, with broken rows left out; else a contract error."""
    broken = schema_violations(df, contract)
    if contract.strict and broken:
        raise make(Code.CONTRACT_VIOLATION, f"contract of '{contract.table}': {broken[0]}", violations=broken)
    return contract_rows(df, contract)
