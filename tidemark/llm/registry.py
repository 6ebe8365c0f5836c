"""Names of the registered queries and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from tidemark.llm import queries as q
from tidemark.llm.oracles import ORACLES


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
