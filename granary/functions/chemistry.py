"""Pluggable canonical forms: a text implementation, and a chemical one only where its library is there."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Canonicalizer(Protocol):
    """Canonical form of a string column; null where a string has none."""

    def __call__(self, s: Column) -> Column: ...


def text_form(s: Column) -> Column:
    """Trimmed, single-spaced text; says nothing about chemical identity."""
    out = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(out != "", out)


def chemical_form() -> Canonicalizer:
    """Canonical molecule strings by an optional library, in Arrow batches; raises ImportError without it."""
    from rdkit import Chem

    def convert(batch: pd.Series) -> pd.Series:
        def one(s):
            mol = Chem.MolFromSmiles(s) if isinstance(s, str) and s else None
            return Chem.MolToSmiles(mol) if mol is not None else None

        return batch.map(one)

    return F.pandas_udf(convert, "string")


def canonicalizer(name: str = "text") -> Canonicalizer:
    """``text``, or ``chemistry`` where its library is installed."""
    return {"text": lambda: text_form, "chemistry": chemical_form}[name]()
