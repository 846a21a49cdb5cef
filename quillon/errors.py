"""Error codes in five ranges, their categories and hints, and the mapping from Spark's error classes."""

from __future__ import annotations

import json
import re
from enum import IntEnum
from typing import Any


class Code(IntEnum):
    # Stable codes that clients match on.
    SOURCE_NOT_FOUND = 1001
    CONNECTION_TIMEOUT = 1002
    SSL_HANDSHAKE_FAILED = 1003
    POOL_EXHAUSTED = 1004
    UNSUPPORTED_SOURCE_TYPE = 1005
    DATABASE_ERROR = 1006
    SYNTAX_ERROR = 2001
    FIELD_NOT_FOUND = 2002
    TABLE_NOT_FOUND = 2003
    TYPE_MISMATCH = 2004
    AMBIGUOUS_COLUMN = 2005
    BUDGET_EXCEEDED = 2006
    PUSHDOWN_UNSUPPORTED = 2007
    QUERY_CANCELLED = 2008
    DRIFT_MISSING_COLUMN = 2009
    DRIFT_TYPE_CHANGED = 2010
    DRIFT_EXTRA_COLUMN = 2011
    PROMPT_INJECTION = 2012
    INVALID_YAML = 3001
    SCHEMA_VIOLATION = 3002
    MISSING_FIELD = 3003
    INVALID_CONNECTION_STRING = 3004
    CONTRACT_VIOLATION = 3005
    CONFIG_ERROR = 3006
    AUTHENTICATION_FAILED = 4001
    AUTHORIZATION_DENIED = 4002
    INVALID_API_KEY = 4003
    TOKEN_EXPIRED = 4004
    SLOT_UNAVAILABLE = 4005
    ENGINE_INTERNAL = 5001
    SERIALIZATION_FAILED = 5002
    INTERNAL_STATE = 5003
    NOT_IMPLEMENTED = 5004
    SIDECAR_ERROR = 5005
    UNKNOWN = 9999

    @property
    def label(self) -> str:
        return f"QUILLON-{int(self):04d}"

    @property
    def category(self) -> str:
        return {1: "connection", 2: "query", 3: "config", 4: "auth"}.get(int(self) // 1000, "internal")


class EngineError(Exception):
    """An error with a code, a JSON context and a hint."""

    def __init__(self, code: Code, message: str, hint: str | None = None, **context: Any):
        super().__init__(f"[{code.label}] {message}" + (f" ({hint})" if hint else ""))
        self.code, self.message, self.hint, self.context = code, message, hint, context

    @property
    def category(self) -> str:
        return self.code.category

    def to_dict(self) -> dict:
        return {"code": self.code.label, "category": self.category, "message": self.message, "hint": self.hint, "context": self.context}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


def _class_for(name: str, prefix: int):
    return type(name, (EngineError,), {"__doc__": f"Errors {prefix}000 to {prefix}999."})


ConnectionFailed, QueryError, ConfigError, AuthError, InternalError = (_class_for(n, i) for i, n in enumerate(("ConnectionFailed", "QueryError", "ConfigError", "AuthError", "InternalError"), 1))
_BY_CATEGORY = {"connection": ConnectionFailed, "query": QueryError, "config": ConfigError, "auth": AuthError, "internal": InternalError}


def make(code: Code, message: str, hint: str | None = None, **context: Any) -> EngineError:
    return _BY_CATEGORY[code.category](code, message, hint, **context)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def did_you_mean(name: str, known: list[str], most: int = 3) -> str | None:
    """The nearest known name within an edit distance of ``most``, whatever its case."""
    near = sorted((levenshtein(name.lower(), k.lower()), k) for k in known)
    return near[0][1] if near and near[0][0] <= most else None


#: Spark's error conditions, by their beginnings.
_CONDITIONS = [
    ("TABLE_OR_VIEW_NOT_FOUND", Code.TABLE_NOT_FOUND),
    ("SCHEMA_NOT_FOUND", Code.TABLE_NOT_FOUND),
    ("UNRESOLVED_COLUMN", Code.FIELD_NOT_FOUND),
    ("FIELD_NOT_FOUND", Code.FIELD_NOT_FOUND),
    ("PARSE_", Code.SYNTAX_ERROR),
    ("INVALID_SQL_SYNTAX", Code.SYNTAX_ERROR),
    ("AMBIGUOUS_REFERENCE", Code.AMBIGUOUS_COLUMN),
    ("DATATYPE_MISMATCH", Code.TYPE_MISMATCH),
    ("CAST_INVALID_INPUT", Code.TYPE_MISMATCH),
    ("UNSUPPORTED_FEATURE", Code.NOT_IMPLEMENTED),
]


def from_spark(error: Exception, names: list[str] = ()) -> EngineError:
    """The engine's error for one that Spark raised; ``names`` are offered as corrections."""
    if isinstance(error, EngineError):
        return error
    condition = getattr(error, "getCondition", lambda: None)() or ""
    text = str(error).split("\n")[0]
    code = next((c for start, c in _CONDITIONS if condition.startswith(start)), Code.UNKNOWN)
    if code is Code.UNKNOWN and re.search(r"cancelled|canceled", text, re.I):
        code = Code.QUERY_CANCELLED
    elif code is Code.UNKNOWN and condition:
        code = Code.ENGINE_INTERNAL
    wrong = re.search(r"`([^`]+)`(?!.*`)", text) or re.search(r"`([^`]+)`", text)
    near = did_you_mean(wrong[1].rsplit(".", 1)[-1], list(names)) if wrong and code in (Code.TABLE_NOT_FOUND, Code.FIELD_NOT_FOUND) else None
    return make(code, text, f"did you mean '{near}'?" if near else None, condition=condition)
