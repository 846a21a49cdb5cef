"""Named query plans of the engine, with the SQL that each is held against."""

from quillon.plans import native, relational, scalar  # noqa: F401  they fill the registry
from quillon.plans.registry import ORACLES, QUERIES

QUERIES["contract_violations"], ORACLES["contract_violations"] = QUERIES.pop("contract_violations_report"), ORACLES.pop("contract_violations_report")

__all__ = ["ORACLES", "QUERIES"]
