"""Scalar string functions over tagged text, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_separators(s: Column) -> Column:
    """Component separators ``;`` with any spaces around become ``.``."""
    return F.regexp_replace(s, r"\s*;\s*", ".")


def strip_tags(s: Column, *tags: str) -> Column:
    return F.trim(F.regexp_replace(s, "</?(?:" + "|".join(tags) + ")>", ""))


def tag_content(s: Column, tag: str) -> Column:
    """Trimmed content of the first closed tag; null if there is none."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(s.rlike(pattern), F.regexp_replace(F.regexp_extract(s, pattern, 1), r"^\s+|\s+$", ""))


def tag_content_open(s: Column, tag: str) -> Column:
    """Content of the first closed tag, else all after an open one; not trimmed."""
    closed, open_ = f"(?s)<{tag}>(.*?)</{tag}>", f"(?s)<{tag}>(.*)"
    return F.when(s.rlike(closed), F.regexp_extract(s, closed, 1)).when(s.rlike(open_), F.regexp_extract(s, open_, 1))


def float_tag(s: Column) -> Column:
    """Number in a FLOAT tag written with ``<|c|>`` tokens; null if absent or unreadable."""
    return F.trim(F.regexp_replace(tag_content(s, "FLOAT"), r"<\|(.)\|>", "$1")).try_cast("double")


def boolean_tag(s: Column) -> Column:
    """Truth of a BOOLEAN tag; a comma list is true if any part is."""
    said = F.lower(tag_content(s, "BOOLEAN"))
    parts = F.transform(F.split(said, ","), lambda p: F.trim(p))
    return F.when(said.contains(","), F.exists(parts, lambda p: p == "true")).when(said == "true", True).when(said == "false", False)


def wrap_float(x: Column) -> Column:
    """Ten decimals, a sign, cut to seven characters, each a ``<|c|>`` token, in FLOAT tags."""
    said = F.format_string("%.10f", x.cast("double"))
    signed = F.when(said.contains("-") | said.contains("+"), said).otherwise(F.concat(F.lit("+"), said))
    return F.concat(F.lit("<FLOAT> "), F.regexp_replace(F.substring(signed, 1, 7), "(.)", r"<|$1|>"), F.lit(" </FLOAT>"))


def wrap_boolean(x: Column) -> Column:
    """Strings with true or yes, then false or no; null for any other."""
    low = F.lower(x)
    said = F.when(low.contains("true") | low.contains("yes"), "True").when(low.contains("false") | low.contains("no"), "False")
    return F.concat(F.lit("<BOOLEAN> "), said, F.lit(" </BOOLEAN>"))


def wrap_names(names: Column) -> Column:
    """A list of names with as many Trues."""
    return F.concat(F.array_join(names, ", "), F.lit(" <BOOLEAN> "), F.array_join(F.transform(names, lambda _: F.lit("True")), ", "), F.lit(" </BOOLEAN>"))


def space_tags(s: Column, tag: str) -> Column:
    """Exactly one space inside both ends of a tag."""
    return F.regexp_replace(F.regexp_replace(s, rf"<{tag}>\s*", f"<{tag}> "), rf"\s*</{tag}>", f" </{tag}>")


def retag(s: Column, old: str, new: str, convert=lambda content: content) -> Column:
    """Every ``old`` tag as a ``new`` one with converted content; null if a content can't be converted."""
    pattern = rf"(?s)<{old}>\s*(.*?)\s*</{old}>"
    contents = F.regexp_extract_all(s, F.lit(pattern), 1)
    between = F.split(F.regexp_replace(s, pattern, "\u0001"), "\u0001")
    converted = F.transform(contents, lambda c: F.concat(F.lit(f"<{new}> "), F.when(c.isin("", "<None>"), c).otherwise(convert(c)), F.lit(f" </{new}>")))
    pieces = F.concat(F.transform(F.arrays_zip(F.slice(between, 1, F.size(between) - 1).alias("b"), converted.alias("c")), lambda z: F.concat(z["b"], z["c"])), F.slice(between, -1, 1))
    return F.when(F.exists(converted, lambda c: c.isNull()), None).otherwise(F.array_join(pieces, ""))


def strip_graph(s: Column) -> Column:
    return F.regexp_replace(s, "(?s)<GRAPH>.*?</GRAPH>", "")


def entity_key(s: Column, *tags: str) -> Column:
    """Join key of a text: tags off, lower case, single spaces; null for nothing or ``<None>``. Text identity, not chemistry."""
    bare = strip_tags(s, *tags) if tags else s
    key = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return F.when(key.isin("", "<none>"), None).otherwise(key)


def component_key(s: Column, sides: str = ">>", parts: str = r"\.", canonical=lambda part: F.trim(part)) -> Column:
    """Each side's parts made canonical, empties dropped, sorted and joined; null if a part has no canonical form."""

    def side(x: Column) -> Column:
        made = F.transform(F.split(x, parts), canonical)
        return F.when(F.exists(made, lambda p: p.isNull()), None).otherwise(F.array_join(F.array_sort(F.filter(made, lambda p: p != "")), "."))

    made = F.transform(F.split(s, sides), side)
    return F.when(F.exists(made, lambda p: p.isNull()), None).otherwise(F.array_join(made, ">>"))


def prompt(user: Column, system: str, model: str) -> Column:
    """Chat prompt in the header style of llama-3-like models, else in the instruction style."""
    if "llada" in model.lower() or "llama-3" in model.lower():
        head = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
        return F.concat(F.lit(f"<|startoftext|>{head('system')}{system}<|eot_id|>{head('user')}"), user, F.lit(f"<|eot_id|>{head('assistant')}"))
    return F.concat(F.lit(f"<s>[INST] {system} \n\n"), user, F.lit(" [/INST] "))


def target(label: Column, model: str) -> Column:
    return F.concat(label, F.lit("<|eot_id|>" if "llada" in model.lower() or "llama-3" in model.lower() else " </s>"))


def fill_instruction(instruction: Column, mol: Column, n: int = 32, token: str = "<mol>") -> Column:
    """The input and its graph block in place of ``<INPUT>``; without one the graph block is appended."""
    graph = f"<GRAPH>{token * n}</GRAPH>"
    return F.when(instruction.contains("<INPUT>"), F.replace(instruction, F.lit("<INPUT>"), F.concat(mol, F.lit(graph)))).otherwise(F.concat(instruction, F.lit(graph)))


def plain_task(task: Column) -> Column:
    """``name/0`` and ``name/multi_label_classification`` without their suffix."""
    return F.when(task.endswith("/0"), F.regexp_replace(task, "/0$", "")).when(task.contains("/multi_label_classification"), F.split_part(task, F.lit("/"), F.lit(1))).otherwise(task)


def data_tag(base: Column, toy: Column, dedup: Column) -> Column:
    return F.concat(base, F.when(toy.isNotNull(), F.concat(F.lit("_toy"), toy.cast("string"))).otherwise(""), F.when(dedup, "").otherwise("_nodedup"))


def metric_parts(key: Column) -> Column:
    """``phase/task../metric`` as a struct of the three."""
    parts = F.split(key, "/")
    return F.struct(parts[0].alias("phase"), F.array_join(F.slice(parts, 2, F.size(parts) - 2), "/").alias("task"), F.element_at(parts, -1).alias("metric"))


def truth_string(x: Column) -> Column:
    """True for numbers above 0 and for 1, true, yes."""
    number = x.try_cast("double")
    return F.when(number.isNotNull(), number > 0).otherwise(F.lower(F.trim(x)).isin("1", "true", "yes"))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) == float("inf"), float("nan")).otherwise(x)


def key_values(s: Column) -> Column:
    """``a=1,b=2`` as a map; a part without a sign has a null value, and of a repeated key the last counts."""
    pairs = F.transform(F.filter(F.split(s, ","), lambda p: p != ""), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.when(p.contains("="), F.trim(F.regexp_replace(p, "^[^=]*=", ""))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
