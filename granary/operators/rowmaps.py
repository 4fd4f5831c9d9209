"""Row maps of a dataset build: source rows become records, records become prompts and targets.

Every map is a struct column (label, input_mol_string, instruction) that is null where a row can't be used, so maps compose with
``select`` and stay inside generated code; ``compact`` and ``invalid_counts`` then keep or count. What needs chemistry is passed in
as functions of columns (``canonical``, ``decode``, ``encode``: null where a string has no such form), text stand-ins by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import taxonomy as X
from granary.functions.text import clean_separators, fill_instruction, plain_task, prompt, retag, space_tags, target, wrap_boolean, wrap_float, wrap_names

Form = Callable[[Column], Column]

# Task names and tokens that records share with existing data sets.
NONE = "<None>"
BETWEEN = "|>>|"
NO_LABEL = "No toxicity identified. "
QM9 = {
    "qm9_additional_label/mu": "qm9_dipole_moment", "qm9_additional_label/alpha": "qm9_isotropic_polarizability", "qm9_additional_label/r2": "qm9_electronic_spatial_extent",
    "qm9_additional_label/zpve": "qm9_zero_point_vibrational_energy", "qm9_additional_label/cv": "qm9_heat_capacity_298K", "qm9_additional_label/u298": "qm9_internal_energy_298K",
    "qm9_additional_label/h298": "qm9_enthalpy_298K", "qm9_additional_label/g298": "qm9_free_energy_298K",
}


def inside(s: Column, tag: str, space: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}>{space}"), s, F.lit(f"{space}</{tag}>"))


def in_words(s: Column) -> Column:
    """The text stand-in for a canonical form: trimmed and single-spaced; null for nothing."""
    out = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(out != "", out)


def labelled(label: Column, task: Column) -> Column:
    """A string label as its kind of task writes it; null for an unknown task or an unreadable class label."""
    number = F.coalesce(wrap_float(label.try_cast("double")), inside(F.regexp_replace(F.substring(F.when(label.rlike("[-+]"), label).otherwise(F.concat(F.lit("+"), label)), 1, 7), "(?s)(.)", r"<|$1|>"), "FLOAT", " "))
    return (
        F.when(task.isin(X.CLASSIFICATION), wrap_boolean(label))
        .when(task.isin(X.REGRESSION), number)
        .when(task.isin(X.MOL2TEXT), inside(label, "DESCRIPTION"))
        .when(task.isin(X.REACTION + X.TEXT2MOL) | (task == "smol-name_conversion-i2s"), inside(label, "SMILES"))
        .when(task.isin(X.NAME_CONVERSION), label)
    )


def _row(ok: Column, label: Column, mol: Column, instruction: Column) -> Column:
    whole = ok & label.isNotNull() & mol.isNotNull() & instruction.isNotNull()
    return F.when(whole, F.struct(label.alias("label"), inside(mol, "SMILES", " ").alias("input_mol_string"), instruction.alias("instruction")))


def property_row(smiles: Column, output: Column, task: Column, instruction: Column, canonical: Form = in_words) -> Column:
    """A molecule with one property."""
    return _row(smiles.isNotNull(), labelled(output, task), canonical(smiles), instruction)


def multilabel_row(smiles: Column, flags: Column, names: Column, instruction: Column, canonical: Form = in_words) -> Column:
    """A molecule with an array of flags: the names of those set, each with a True, or a sentence where none is."""
    said = F.transform(F.filter(F.arrays_zip(flags.alias("flag"), names.alias("name")), lambda z: z["flag"]), lambda z: z["name"])
    label = F.when(F.size(said) > 0, wrap_names(said)).otherwise(F.concat(F.lit(NO_LABEL), wrap_boolean(F.lit("False"))))
    return _row(smiles.isNotNull() & flags.isNotNull(), label, canonical(smiles), instruction)


def decoded(s: Column, decode: Form) -> Column:
    """Each side of a reaction decoded; null if one side can't be."""
    sides = F.transform(F.split(s, ">>"), lambda x: decode(F.trim(x)))
    return F.when(~F.exists(sides, lambda x: x.isNull()), F.array_join(sides, ">>"))


def instruction_row(given: Column, output: Column, task: Column, instruction: Column, canonical: Form = in_words, decode: Form | None = None) -> Column:
    """An instruction source: reagents have two sides, other reactions keep their input, single molecules become canonical."""
    reaction, reagent = task.isin(X.REACTION), task == "reagent_prediction"
    source, label = given, output
    if decode is not None:
        source, label = decoded(given, decode), F.when(reaction, decoded(output, decode)).otherwise(output)
    sides = F.when(source.contains(">>") & ~source.contains(BETWEEN), F.replace(source, F.lit(">>"), F.lit(f"</SMILES>{BETWEEN}<SMILES>"))).when(source.contains(BETWEEN), source)
    single = canonical(F.trim(source))
    mol = F.when(reagent, sides).when(reaction, F.when(single.isNotNull(), source)).otherwise(single)
    return _row(given.isNotNull() & output.isNotNull(), labelled(label, task), mol, instruction)


def multitask_row(given: Column, output: Column, task: Column, instruction: Column, example: Column, canonical: Form = in_words) -> Column:
    """A multi-task source. ``example`` is the source's own instruction, whose bracketed part is the place of the input."""
    names, shown = task.isin("smol-name_conversion-i2s", "smol-name_conversion-i2f"), task.isin(X.TEXT2MOL)
    spelled = task.isin("smol-name_conversion-s2i", "smol-name_conversion-s2f")
    sider = task == "smol-property_prediction-sider"
    clean = clean_separators(given)
    mol = F.when(names | shown, F.lit(NONE)).when(spelled, F.coalesce(canonical(clean), clean)).otherwise(canonical(clean))
    said = F.when(names, F.replace(instruction, F.lit("<INPUT>"), inside(given, "IUPAC"))).when(shown, F.replace(instruction, F.lit("<INPUT>"), inside(given, "DESCRIPTION"))).when(sider, F.regexp_replace(example, r"\[.*\]", "<INPUT>")).otherwise(instruction)
    label = F.when(names | shown, clean_separators(output)).otherwise(output)
    known = task.isin(X.NAME_CONVERSION + X.TEXT2MOL + X.REACTION + X.MOL2TEXT + X.CLASSIFICATION + X.REGRESSION)
    return _row(known & given.isNotNull(), labelled(label, task), mol, said)


def description_row(description: Column, molecule: Column, task: Column, instruction: Column, canonical: Form = in_words, decode: Form | None = None) -> Column:
    """A molecule and its description, asked in the task's direction."""
    smiles = decode(molecule) if decode is not None else F.coalesce(canonical(molecule), molecule)
    written = task.isin(X.TEXT2MOL)
    mol = F.when(written, F.lit(NONE)).when(task.isin(X.MOL2TEXT), smiles)
    said = F.when(written, F.replace(instruction, F.lit("<INPUT>"), inside(description, "DESCRIPTION"))).otherwise(instruction)
    return _row(description.isNotNull() & molecule.isNotNull(), labelled(F.when(written, smiles).otherwise(description), task), mol, said)


def main_row(record: DataFrame, system: str, model: str = "mistral", encode: Form = F.upper, token: str = "<mol>", n: int = 32) -> DataFrame:
    """(label, input_mol_string, instruction, task_subtask_pair, ...) -> task, the six texts in both notations, ``_valid``, and all other columns.

    Where a tag's content has no other notation the texts are empty, the task keeps its raw name and ``_valid`` is false.
    """
    mol, label = F.col("input_mol_string"), F.col("label")
    other_mol, other_label = retag(mol, "SMILES", "SELFIES", encode), retag(label, "SMILES", "SELFIES", encode)
    ok = F.coalesce(other_mol.isNotNull() & other_label.isNotNull(), F.lit(False))
    mols = {"smiles": space_tags(mol, "SMILES"), "selfies": space_tags(F.col("_other_mol"), "SELFIES")}
    labels = {"smiles": label, "selfies": F.col("_other_label")}
    raw = F.col("task_subtask_pair")
    renamed = F.coalesce(F.create_map(*[F.lit(x) for pair in QM9.items() for x in pair])[raw], raw)
    task = F.when(F.col("_valid"), F.when(raw.contains("qm9_additional_label"), renamed).otherwise(plain_task(raw))).otherwise(raw)
    told = record.withColumns({"_other_mol": other_mol, "_other_label": other_label, "_valid": ok})
    texts = {}
    for kind in ("smiles", "selfies"):
        texts[f"prompt_text_{kind}"] = prompt(fill_instruction(F.col("instruction"), mols[kind], n, token), system, model)
        texts[f"target_text_{kind}"] = target(labels[kind], model)
        texts[f"input_mol_string_{kind}"] = mols[kind]
    made = [F.when(F.col("_valid"), x).otherwise("").alias(k) for k, x in texts.items()]
    used = {"label", "input_mol_string", "instruction", "task_subtask_pair", "task", *texts}
    return told.select(task.alias("task"), *made, "_valid", *[F.col(f"`{c}`") for c in record.columns if c not in used])


def compact(mapped: DataFrame, row: str = "row") -> DataFrame:
    """Rows that could be mapped, with the struct's fields as columns."""
    return mapped.where(F.col(row).isNotNull()).select(*[F.col(f"`{c}`") for c in mapped.columns if c != row], f"{row}.*")


def invalid_counts(mapped: DataFrame, by: list[str], row: str = "row") -> DataFrame:
    """Per group: rows kept and rows that couldn't be mapped."""
    return mapped.groupBy(*by).agg(F.count(row).alias("valid"), F.count_if(F.col(row).isNull()).alias("invalid"))


def valid_only(rows: DataFrame, flag: str = "_valid") -> DataFrame:
    return rows.where(F.col(flag)).drop(flag)


def records(rows: DataFrame, first: str, second: str, empty: Column) -> DataFrame:
    """Graph structs (x, edge_index, edge_attr) as six columns; a missing second graph is ``empty``, rows without a first go."""
    other = F.coalesce(F.col(second), empty)
    parts = ("x", "edge_index", "edge_attr")
    graphs = [F.col(first)[p].alias(p) for p in parts] + [other[p].alias(f"additional_{p}") for p in parts]
    return rows.where(F.col(first).isNotNull()).select(*[F.col(f"`{c}`") for c in rows.columns if c not in (first, second)], *graphs)


def picked(rows: DataFrame, name: str, include: list[str] | None, exclude: list[str] | None, first: int | None, order: str) -> DataFrame:
    """Included names, then without the excluded, then the ``first`` rows by ``order`` (all if null)."""
    out = rows.where(F.col(name).isin(include)) if include is not None else rows
    out = out.where(~F.coalesce(F.col(name).isin(exclude), F.lit(False))) if exclude else out
    return out.orderBy(order).limit(first) if first is not None else out


def dual_columns(rows: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Reader over tables in one or both notations: texts of ``kind`` under plain names; chosen and rejected fall back to the target; ``_val_idx`` is the stored id."""
    has = set(rows.columns)
    both = {c: F.col(f"{c}_{kind}") for c in ("prompt_text", "target_text", "input_mol_string", "target_text_chosen", "target_text_rejected") if f"{c}_{kind}" in has}
    out = rows.withColumns(both) if both else rows
    if "target_text" in out.columns:
        missing = [c for c in ("target_text_chosen", "target_text_rejected") if c not in out.columns]
        out = out.withColumns({c: F.col("target_text") for c in missing}) if missing else out
    return out.withColumn("_val_idx", F.col(id_col).cast("long"))
