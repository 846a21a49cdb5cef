"""What a source is: a provider that turns a SourceConfig into named tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql import types as T

from quillon.config import SourceConfig


@dataclass
class Table:
    """A named table of a source. ``load`` makes its frame afresh; ``remote`` is its name at the source."""

    schema: str
    name: str
    load: Callable[[], DataFrame]
    declared: T.StructType | None = None
    remote: str | None = None
    comment: str | None = None
    rows: Callable[[], int | None] = lambda: None


class SourceProvider(ABC):
    """One type of source. Subclass and register to plug in another."""

    type_name: str = ""
    aliases: tuple[str, ...] = ()
    dialect: str | None = None

    @abstractmethod
    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        """The source's tables, declared or introspected."""

    def context(self, config: SourceConfig) -> Any:
        """Equal values mean the same database, so that one statement may span their tables. None: no pushdown."""
        return None

    def dialect_of(self, config: SourceConfig) -> str | None:
        return self.dialect

    def run_remote(self, spark: SparkSession, config: SourceConfig, sql: str, schema: StructType) -> DataFrame:
        """A whole statement, run by the source, with the column names and types of ``schema``."""
        raise NotImplementedError


def schema_of(config: SourceConfig, declared: str) -> str:
    """SQL sources keep their tables in a schema of their own name unless one is declared."""
    return config.name if declared in ("", "public", "main") else declared


@dataclass
class Registry:
    """Providers by type name and alias."""

    providers: dict[str, SourceProvider] = field(default_factory=dict)

    def add(self, provider: SourceProvider) -> None:
        for name in (provider.type_name, *provider.aliases):
            self.providers[name] = provider

    def get(self, name: str) -> SourceProvider:
        from quillon.errors import Code, did_you_mean, make

        if name not in self.providers:
            near = did_you_mean(name, list(self.providers))
            raise make(Code.UNSUPPORTED_SOURCE_TYPE, f"unsupported source type '{name}'", f"did you mean '{near}'?" if near else None, known=sorted(self.providers))
        return self.providers[name]
