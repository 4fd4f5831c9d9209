"""Task taxonomy as a dimension: which kind of task a name is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task names, tags and control tokens that results must share with existing data sets.
CLASSIFICATION = ["smol-property_prediction-bbbp", "smol-property_prediction-clintox", "smol-property_prediction-hiv", "smol-property_prediction-sider", "bace", "tox21", "toxcast"]
REGRESSION = [
    "smol-property_prediction-esol", "smol-property_prediction-lipo", "qm9_homo", "qm9_lumo", "qm9_homo_lumo_gap", "qm9_dipole_moment", "qm9_isotropic_polarizability",
    "qm9_electronic_spatial_extent", "qm9_zero_point_vibrational_energy", "qm9_heat_capacity_298K", "qm9_internal_energy_298K", "qm9_enthalpy_298K", "qm9_free_energy_298K",
    "alchemy_homo", "alchemy_lumo", "alchemy_homo_lumo_gap", "aqsol-logS", "pcqm_homo_lumo_gap",
]
REACTION = [
    "forward_reaction_prediction", "smol-forward_synthesis", "retrosynthesis", "smol-retrosynthesis", "reagent_prediction", "presto-forward_reaction_prediction", "presto-retrosynthesis",
    "presto-reagent_prediction", "orderly-forward_reaction_prediction", "orderly-retrosynthesis", "orderly-reagent_prediction",
]
TEXT2MOL = ["chebi-20-text2mol", "smol-molecule_generation"]
MOL2TEXT = ["chebi-20-mol2text", "smol-molecule_captioning"]
NAME_CONVERSION = ["smol-name_conversion-i2s", "smol-name_conversion-i2f", "smol-name_conversion-s2f", "smol-name_conversion-s2i"]
TAGS = ["BOOLEAN", "FLOAT", "DESCRIPTION", "SELFIES", "SMILES", "GRAPH", "3D_CONFORMER", "INSTRUCTION", "IUPAC", "MOLFORMULA"]

KINDS = {"classification": CLASSIFICATION, "regression": REGRESSION, "molecule": REACTION + TEXT2MOL, "caption": MOL2TEXT, "name_conversion": NAME_CONVERSION}


def task_dimension(spark: SparkSession) -> DataFrame:
    """(task, kind): one row per known task; a fixed table of 44 rows, safe to broadcast."""
    return spark.createDataFrame([(t, k) for k, ts in KINDS.items() for t in ts], "task string, kind string")


def task_kind(task: Column) -> Column:
    """Kind of a task name; unknown names count as molecule tasks."""
    out = F.lit("molecule")
    for kind, names in KINDS.items():
        out = F.when(task.isin(names), kind).otherwise(out)
    return out
