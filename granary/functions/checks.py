"""Checks and readings of labels and tagged molecules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import taxonomy as X


def label_fault(label: Column, task: Column) -> Column:
    """What is wrong with a label for its kind of task; null if nothing is."""
    without = lambda *signs: ~F.coalesce(F.greatest(*[label.contains(s) for s in signs]), F.lit(False))
    return (
        F.when(task.isin(X.CLASSIFICATION) & without("True", "False"), "classification label without True or False")
        .when(task.isin(X.REGRESSION) & without("<REG>", "<|"), "regression label without number tokens")
        .when(task.isin(X.REACTION) & without("<SMILES>", "<SELFIES>"), "reaction label without molecule tags")
    )


def molecule_content(s: Column) -> Column:
    """(tag, content) of the first tagged molecule; a SMILES tag goes before a SELFIES one; nulls without either."""
    found = F.lit(None).cast("struct<tag:string,content:string>")
    for tag in ("SELFIES", "SMILES"):
        pattern = rf"<{tag}>\s*(.*?)\s*</{tag}>"
        found = F.when(s.rlike(pattern), F.struct(F.lit(tag).alias("tag"), F.regexp_extract(s, pattern, 1).alias("content"))).otherwise(found)
    return found


def bare(s: Column, tag: str, spaces: bool = True) -> Column:
    """``s`` without the tag's marks: trimmed, or with no space at all."""
    out = F.replace(F.replace(s, F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit(""))
    return F.trim(out) if spaces else F.replace(out, F.lit(" "), F.lit(""))


def _parts(s: Column) -> Column:
    """The molecules of a text: sides of a reaction, and what dots part on each."""
    return F.flatten(F.transform(F.split(s, ">>"), lambda side: F.split(F.trim(side), r"\.")))


def _each(s: Column, fits) -> Column:
    return F.forall(_parts(s), lambda p: F.coalesce(fits(F.trim(p)), F.lit(False)))


def selfies_form(s: Column) -> Column:
    """Whether every molecule of a text, or of both sides of a reaction, is a run of bracketed tokens; an empty or null text isn't."""
    return F.coalesce((s != "") & _each(s, lambda p: p.rlike(r"^(\[[^\[\]\s]+\])+$")), F.lit(False))


def smiles_form(s: Column) -> Column:
    """Whether every molecule of a text could be a line notation: known signs only, brackets and ring numbers in pairs.

    An empty text and ``<None>`` stand for no molecule and are valid; what the atoms mean isn't checked.
    """

    def fits(p: Column) -> Column:
        bare_ = F.regexp_replace(p, r"\[[^\[\]]*\]", "")  # bracketed atoms hold numbers that aren't rings
        count = lambda x: F.length(bare_) - F.length(F.replace(bare_, F.lit(x), F.lit("")))
        rings = F.lit(True)
        for digit in "123456789":
            rings = rings & (count(digit) % 2 == 0)
        depth = F.aggregate(F.split(F.regexp_replace(bare_, r"[^()]", ""), ""), F.lit(0), lambda d, c: F.when((d < 0) | ((c == ")") & (d == 0)), -1).otherwise(d + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)))
        return p.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$:/\\%*.]+$") & ~bare_.rlike(r"[\[\]]") & (depth == 0) & rings

    return F.coalesce(s.isNull() | (s == "") | (s == "<None>") | _each(s, fits), F.lit(False))


def fallback_payload(original: Column, swapped: Column, active: Column, ratio: float, reason: Column, last: str = "CCC") -> Column:
    """What stands for a corruption that failed: the original with one part swapped, else the fixed molecule ``last``; nothing counts as removed or added."""
    kind = F.when(swapped.isNotNull() & ~swapped.eqNullSafe(original), "atom_swap_fallback").otherwise(reason)
    return F.struct(
        original.alias("original"), F.when(kind == "atom_swap_fallback", 0).otherwise(active).cast("int").alias("active"), F.lit(0).alias("removed"), F.lit(0).alias("added"), F.lit(0.0).alias("change"),
        F.lit(float(ratio)).alias("wanted"), kind.alias("reason"), F.when(kind == "atom_swap_fallback", swapped).otherwise(last).alias("modified"),
    )
