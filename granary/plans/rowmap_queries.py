"""Row maps over the driver's tables as stand-ins for sources: names and types of parts as molecules, prices as properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import checks
from granary.operators import rowmaps as R
from granary.plans.common import Query
from granary.sources.tables import load

SQL_FLOAT = r"""'<FLOAT> ' || regexp_replace(substr(CASE WHEN contains(x, '-') THEN x ELSE '+' || x END, 1, 7), '(.)', '<|\1|>', 'g') || ' </FLOAT>'"""
CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _property(s, d):
    row = R.property_row(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), F.col("p_retailprice").cast("string"), F.lit("aqsol-logS"), F.lit("Tell it of <INPUT>."))
    return load(s, "part", d).select("p_partkey", "p_brand", row.alias("row"))


def _multilabel(s, d):
    flags = F.array(*[(F.col("p_partkey") % k == 0) for k in (2, 3, 5)])
    return load(s, "part", d).select("p_partkey", R.multilabel_row(F.col("p_name"), flags, F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("Which?")).alias("row"))


def _instruction(s, d):
    n = F.col("p_partkey") % 4
    task = F.element_at(F.array(F.lit("reagent_prediction"), F.lit("retrosynthesis"), F.lit("qm9_homo"), F.lit("no such task")), (n + 1).cast("int"))
    given = F.when(n == 0, F.concat_ws(">>", "p_name", "p_type")).otherwise(F.concat(F.lit(" "), "p_name"))
    output = F.when(F.col("p_partkey") % 11 != 0, F.when(n == 2, F.col("p_size").cast("string")).otherwise(F.col("p_type")))
    return load(s, "part", d).select("p_partkey", task.alias("task"), R.instruction_row(given, output, task, F.lit("Do <INPUT>")).alias("row"))


def _multitask(s, d):
    names = ["smol-name_conversion-i2s", "smol-name_conversion-s2i", "smol-molecule_generation", "smol-retrosynthesis", "smol-property_prediction-sider", "smol-molecule_captioning"]
    n = F.col("p_partkey") % 6
    task = F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    given = F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.concat_ws(" ; ", "p_name", "p_brand"))
    output = F.when(n == 4, F.when(F.col("p_size") > 25, "Yes").otherwise("No")).otherwise(F.col("p_type"))
    example = F.concat(F.lit("Is ["), "p_name", F.lit("] or [it] bad?"))
    return load(s, "part", d).select("p_partkey", task.alias("task"), R.multitask_row(given, output, task, F.lit("Use <INPUT>"), example).alias("row"))


def _description(s, d):
    task = F.when(F.col("p_partkey") % 2 == 0, "chebi-20-text2mol").otherwise("chebi-20-mol2text")
    return load(s, "part", d).select("p_partkey", R.description_row(F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")), F.col("p_name"), task, F.lit("Go <INPUT>")).alias("row"))


def _main(s, d):
    row = R.description_row(F.col("p_type"), F.col("p_name"), F.lit("chebi-20-mol2text"), F.lit("Go <INPUT>"))
    pair = F.element_at(F.array(F.lit("qm9_additional_label/mu"), F.lit("bace/0"), F.lit("tox21/multi_label_classification"), F.lit("x/1")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = R.compact(load(s, "part", d).select("p_partkey", pair.alias("task_subtask_pair"), row.alias("row")))
    return R.main_row(rows, "Be brief.", "mistral", encode=lambda x: F.when(F.length(x) % 5 != 0, F.upper(x)))


def _records(s, d):
    graph = F.struct(F.array(F.array(F.col("l_partkey"))).alias("x"), F.array(F.array(F.col("l_suppkey"))).alias("edge_index"), F.array(F.array(F.col("l_linenumber").cast("long"))).alias("edge_attr"))
    rows = load(s, "lineitem", d).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, graph).alias("g0"), F.when(F.col("l_linenumber") > 3, graph).alias("g1"))
    empty = F.struct(F.array(F.array(F.lit(0).cast("long"))).alias("x"), F.array(F.array(F.lit(0).cast("long"))).alias("edge_index"), F.array(F.array(F.lit(0).cast("long"))).alias("edge_attr"))
    out = R.records(rows, "g0", "g1", empty)
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"{p}{c}")[0][0].alias(f"{p}{c}") for p in ("", "additional_") for c in ("x", "edge_index", "edge_attr")])


def _dual(s, d):
    rows = load(s, "nation", d).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("prompt_text_smiles"), F.lower("n_name").alias("target_text_smiles"), F.lit("m").alias("input_mol_string_smiles"))
    return R.dual_columns(rows, "smiles", "id").select("_val_idx", "prompt_text", "target_text", "input_mol_string", "target_text_chosen", "target_text_rejected")


def _checked(s, d):
    n = F.col("p_partkey") % 6
    task = F.element_at(F.array(*map(F.lit, ["bace", "bace", "qm9_homo", "qm9_homo", "retrosynthesis", "retrosynthesis"])), (n + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ["<BOOLEAN> True </BOOLEAN>", "maybe", "<FLOAT> <|+|> </FLOAT>", "1.5", "<SMILES>C</SMILES>", "C"])), (n + 1).cast("int"))
    return load(s, "part", d).select("p_partkey", checks.label_fault(label, task).alias("fault"))


def _content(s, d):
    said = F.when(F.col("p_partkey") % 3 == 0, R.inside(F.col("p_name"), "SELFIES", " ")).when(F.col("p_partkey") % 3 == 1, F.concat(R.inside(F.col("p_type"), "SELFIES"), R.inside(F.col("p_name"), "SMILES", "  "))).otherwise(F.col("p_name"))
    content = checks.molecule_content(said)
    return load(s, "part", d).select("p_partkey", content["tag"].alias("tag"), content["content"].alias("content"), checks.bare(said, "SELFIES").alias("bare"), checks.bare(said, "SELFIES", spaces=False).alias("dense"))


QUERIES: dict[str, Query] = {
    "map_property_rows": (
        lambda s, d: R.compact(_property(s, d)).select("p_partkey", "label", "input_mol_string", "instruction"),
        f"""SELECT p_partkey, {SQL_FLOAT} AS label, '<SMILES> ' || c || ' </SMILES>' AS input_mol_string, 'Tell it of <INPUT>.' AS instruction
        FROM (SELECT *, {CLEAN.format('p_name')} AS c, printf('%.10f', p_retailprice) AS x FROM part) WHERE p_partkey % 7 <> 0""",
    ),
    "map_invalid_counts": (
        lambda s, d: R.invalid_counts(_property(s, d), ["p_brand"]),
        "SELECT p_brand, count(*) FILTER (p_partkey % 7 <> 0) AS valid, count(*) FILTER (p_partkey % 7 = 0) AS invalid FROM part GROUP BY p_brand",
    ),
    "map_multilabel_rows": (
        lambda s, d: R.compact(_multilabel(s, d)).select("p_partkey", "label", "input_mol_string"),
        f"""SELECT p_partkey, CASE WHEN len(n) = 0 THEN 'No toxicity identified. <BOOLEAN> False </BOOLEAN>' ELSE array_to_string(n, ', ') || ' <BOOLEAN> ' || array_to_string(list_transform(n, lambda x: 'True'), ', ') || ' </BOOLEAN>' END AS label,
        '<SMILES> ' || c || ' </SMILES>' AS input_mol_string FROM (SELECT *, {CLEAN.format('p_name')} AS c, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'a' END, CASE WHEN p_partkey % 3 = 0 THEN 'b' END, CASE WHEN p_partkey % 5 = 0 THEN 'c' END], lambda x: x IS NOT NULL) AS n FROM part)""",
    ),
    "map_instruction_rows": (
        lambda s, d: R.compact(_instruction(s, d)).select("p_partkey", "task", "label", "input_mol_string", "instruction"),
        f"""SELECT p_partkey, ['reagent_prediction', 'retrosynthesis', 'qm9_homo'][k + 1] AS task, CASE k WHEN 2 THEN {SQL_FLOAT} ELSE '<SMILES>' || p_type || '</SMILES>' END AS label,
        '<SMILES> ' || CASE k WHEN 0 THEN p_name || '</SMILES>|>>|<SMILES>' || p_type WHEN 1 THEN ' ' || p_name ELSE {CLEAN.format('p_name')} END || ' </SMILES>' AS input_mol_string, 'Do <INPUT>' AS instruction
        FROM (SELECT *, p_partkey % 4 AS k, printf('%.10f', CAST(p_size AS DOUBLE)) AS x FROM part) WHERE k < 3 AND p_partkey % 11 <> 0""",
    ),
    "map_multitask_rows": (
        lambda s, d: R.compact(_multitask(s, d)).select("p_partkey", "task", "label", "input_mol_string", "instruction"),
        f"""SELECT p_partkey, ['smol-name_conversion-i2s', 'smol-name_conversion-s2i', 'smol-molecule_generation', 'smol-retrosynthesis', 'smol-property_prediction-sider', 'smol-molecule_captioning'][k + 1] AS task,
        CASE WHEN k IN (0, 2, 3) THEN '<SMILES>' || p_type || '</SMILES>' WHEN k = 1 THEN p_type WHEN k = 4 THEN '<BOOLEAN> ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || ' </BOOLEAN>' ELSE '<DESCRIPTION>' || p_type || '</DESCRIPTION>' END AS label,
        '<SMILES> ' || CASE WHEN k IN (0, 2) THEN '<None>' ELSE coalesce(nullif({CLEAN.format('c')}, ''), c) END || ' </SMILES>' AS input_mol_string,
        CASE k WHEN 0 THEN 'Use <IUPAC>' || g || '</IUPAC>' WHEN 2 THEN 'Use <DESCRIPTION>' || g || '</DESCRIPTION>' WHEN 4 THEN 'Is <INPUT> bad?' ELSE 'Use <INPUT>' END AS instruction
        FROM (SELECT *, regexp_replace(g, '\\s*;\\s*', '.', 'g') AS c FROM (SELECT *, p_partkey % 6 AS k, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name || ' ; ' || p_brand END AS g FROM part)) WHERE g <> '' OR k < 3""",
    ),
    "map_description_rows": (
        lambda s, d: R.compact(_description(s, d)).select("p_partkey", "label", "input_mol_string", "instruction"),
        f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<SMILES>' || c || '</SMILES>' ELSE '<DESCRIPTION>' || p_type || '</DESCRIPTION>' END AS label, '<SMILES> ' || CASE WHEN p_partkey % 2 = 0 THEN '<None>' ELSE c END || ' </SMILES>' AS input_mol_string,
        CASE WHEN p_partkey % 2 = 0 THEN 'Go <DESCRIPTION>' || p_type || '</DESCRIPTION>' ELSE 'Go <INPUT>' END AS instruction FROM (SELECT *, {CLEAN.format('p_name')} AS c FROM part) WHERE p_partkey % 9 <> 0""",
    ),
    "map_main_rows": (
        lambda s, d: _main(s, d),
        f"""SELECT p_partkey, CASE WHEN NOT ok THEN raw WHEN k = 0 THEN 'qm9_dipole_moment' WHEN k = 1 THEN 'bace' WHEN k = 2 THEN 'tox21' ELSE raw END AS task, ok AS _valid,
        CASE WHEN ok THEN '<SMILES> ' || c || ' </SMILES>' ELSE '' END AS input_mol_string_smiles, CASE WHEN ok THEN '<SELFIES> ' || upper(c) || ' </SELFIES>' ELSE '' END AS input_mol_string_selfies,
        CASE WHEN ok THEN '<s>[INST] Be brief. ' || chr(10) || chr(10) || 'Go <SMILES> ' || c || ' </SMILES><GRAPH>' || repeat('<mol>', 32) || '</GRAPH> [/INST] ' ELSE '' END AS prompt_text_smiles,
        CASE WHEN ok THEN '<s>[INST] Be brief. ' || chr(10) || chr(10) || 'Go <SELFIES> ' || upper(c) || ' </SELFIES><GRAPH>' || repeat('<mol>', 32) || '</GRAPH> [/INST] ' ELSE '' END AS prompt_text_selfies,
        CASE WHEN ok THEN '<DESCRIPTION>' || p_type || '</DESCRIPTION> </s>' ELSE '' END AS target_text_smiles, CASE WHEN ok THEN '<DESCRIPTION>' || p_type || '</DESCRIPTION> </s>' ELSE '' END AS target_text_selfies
        FROM (SELECT *, length(c) % 5 <> 0 AS ok, ['qm9_additional_label/mu', 'bace/0', 'tox21/multi_label_classification', 'x/1'][k + 1] AS raw FROM (SELECT *, {CLEAN.format('p_name')} AS c, p_partkey % 4 AS k FROM part))""",
    ),
    "map_valid_only": (
        lambda s, d: R.valid_only(_main(s, d)).groupBy("task").agg(F.count("*").alias("n")),
        f"SELECT ['qm9_dipole_moment', 'bace', 'tox21', 'x/1'][p_partkey % 4 + 1] AS task, count(*) AS n FROM part WHERE length({CLEAN.format('p_name')}) % 5 <> 0 GROUP BY 1",
    ),
    "map_records": (
        lambda s, d: _records(s, d),
        """SELECT l_orderkey, l_linenumber, l_partkey AS x, l_suppkey AS edge_index, CAST(l_linenumber AS BIGINT) AS edge_attr, CASE WHEN l_linenumber > 3 THEN l_partkey ELSE 0 END AS additional_x, CASE WHEN l_linenumber > 3 THEN l_suppkey ELSE 0 END AS additional_edge_index,
        CAST(CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END AS BIGINT) AS additional_edge_attr FROM lineitem WHERE l_linenumber <> 2""",
    ),
    "map_picked": (
        lambda s, d: R.picked(load(s, "documents", d), "lang", ["en", "de", "fr"], ["de"], 30, "doc_id").select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr') AND lang <> 'de' ORDER BY doc_id LIMIT 30",
    ),
    "read_dual_columns": (
        lambda s, d: _dual(s, d),
        "SELECT CAST(n_nationkey AS BIGINT) AS _val_idx, n_name AS prompt_text, lower(n_name) AS target_text, 'm' AS input_mol_string, lower(n_name) AS target_text_chosen, lower(n_name) AS target_text_rejected FROM nation",
    ),
    "label_faults": (
        lambda s, d: _checked(s, d),
        "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'classification label without True or False' WHEN 3 THEN 'regression label without number tokens' WHEN 5 THEN 'reaction label without molecule tags' END AS fault FROM part",
    ),
    "molecule_content": (
        lambda s, d: _content(s, d),
        r"""SELECT p_partkey, CASE k WHEN 0 THEN 'SELFIES' WHEN 1 THEN 'SMILES' END AS tag, CASE WHEN k < 2 THEN trim(p_name) END AS content, trim(replace(replace(t, '<SELFIES>', ''), '</SELFIES>', '')) AS bare, replace(replace(replace(t, '<SELFIES>', ''), '</SELFIES>', ''), ' ', '') AS dense
        FROM (SELECT *, p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN '<SELFIES> ' || p_name || ' </SELFIES>' WHEN 1 THEN '<SELFIES>' || p_type || '</SELFIES><SMILES>  ' || p_name || '  </SMILES>' ELSE p_name END AS t FROM part)""",
    ),
}
