"""Answers scored under question-specific contracts: correct, incorrect, or left to review.

A contract is JSON: its kind (scalar, number, set or ordered), items with
aliases, complete answers accepted and rejected, and, by kind, a closed domain,
a unit, a numeric value with a tolerance, or a separator. What a contract
doesn't know is never declared wrong.
"""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_QUOTES = str.maketrans("’‘“”", "''\"\"")
_PLAIN_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)")
RESULT = StructType().add("status", StringType()).add("reason", StringType())


def surface(answer: str) -> str:
    """Composed, straight quotes, folded, single spaces, without one full stop at the end."""
    plain = " ".join(unicodedata.normalize("NFC", answer).translate(_QUOTES).casefold().split())
    return plain.removesuffix(".").rstrip() if plain.endswith(".") else plain


class Contract:
    """A contract with its surfaces looked up; an inconsistent one is an error."""

    def __init__(self, spec: dict):
        self.kind, self.spec = spec.get("kind"), spec
        if self.kind not in ("scalar", "number", "set", "ordered"):
            raise ValueError(f"unknown kind of contract: {self.kind}")
        self.expected = [item["canonical"] for item in spec.get("items") or []]
        self.known: dict[str, str] = {}
        for item in spec.get("items") or []:
            for name in (item["canonical"], *(item.get("aliases") or [])):
                key = surface(name)
                if not key or self.known.setdefault(key, item["canonical"]) != item["canonical"]:
                    raise ValueError("an alias is empty or stands for two items")
        if not self.expected or len(set(self.expected)) < len(self.expected):
            raise ValueError("a contract needs items, each once")
        if self.kind in ("scalar", "number") and len(self.expected) != 1:
            raise ValueError("one item is needed")
        self.accepted, self.rejected, self.domain = ({surface(x) for x in spec.get(k) or []} for k in ("accepted_complete", "rejected_complete", "closed_domain"))
        if self.rejected & (self.accepted | self.known.keys()):
            raise ValueError("an answer is both accepted and rejected")

    def score(self, answer: str) -> tuple[str, str]:
        said = surface(answer)
        if said in self.accepted:
            return "correct", "accepted answer"
        if said in self.rejected:
            return "incorrect", "rejected answer"
        return getattr(self, f"_{'listed' if self.kind in ('set', 'ordered') else self.kind}")(answer, said)

    def _scalar(self, answer: str, said: str) -> tuple[str, str]:
        if said in self.known:
            return "correct", "known item"
        return ("incorrect", "another of the domain") if said in self.domain else ("review", "unknown answer")

    def _number(self, answer: str, said: str) -> tuple[str, str]:
        if said in self.known:
            return "correct", "known item"
        unit = surface(self.spec.get("unit") or "")
        bare = said.removesuffix(f" {unit}") if unit else said
        if unit and bare == said and not self.spec.get("unit_optional"):
            return "review", "no such unit"
        if not _PLAIN_NUMBER.fullmatch(bare):
            return "review", "not a plain number"
        off = abs(Decimal(bare) - Decimal(str(self.spec["numeric_value"])))
        return ("correct" if off <= Decimal(str(self.spec.get("absolute_tolerance") or 0)) else "incorrect"), "number compared"

    def _listed(self, answer: str, said: str) -> tuple[str, str]:
        items = [answer] if said in self.known else self._items(answer)
        if items is None:
            return "review", "not a list"
        found = [self.known.get(surface(x)) for x in items]
        if None in found:
            return "review", "unknown item"
        same = set(found) == set(self.expected) if self.kind == "set" else found == self.expected
        return ("correct" if same else "incorrect"), "items compared"

    def _items(self, answer: str) -> list[str] | None:
        try:
            items = json.loads(answer)
        except ValueError:
            separator = self.spec.get("separator")
            items = answer.split(separator) if separator else None
        return items if isinstance(items, list) and all(isinstance(x, str) for x in items) else None


@lru_cache(maxsize=4096)
def _parsed(spec: str) -> Contract:
    return Contract(json.loads(spec))


@F.pandas_udf(RESULT)
def _scores(answer: pd.Series, contract: pd.Series) -> pd.DataFrame:
    found = [(None, None) if a is None or c is None else _parsed(c).score(a) for a, c in zip(answer, contract, strict=True)]
    return pd.DataFrame(found, columns=["status", "reason"])


def score(answer: Column, contract: Column) -> Column:
    """struct(status, reason) of an answer under a contract in JSON; null for null."""
    return _scores(answer, contract)
