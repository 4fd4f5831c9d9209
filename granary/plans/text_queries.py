"""Tag parsing, wrapping, templates and other string expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.common import Query
from granary.sources.tables import load

BOOL_SQL = """CASE WHEN m IS NULL THEN NULL WHEN contains(m, ',') THEN len(list_filter(string_split(m, ','), lambda x: trim(x) = 'true')) > 0 WHEN m = 'true' THEN true WHEN m = 'false' THEN false END"""


def _docs(s, d):
    return load(s, "documents", d)


def _orders(s, d):
    return load(s, "orders", d)


def _events(s, d):
    return load(s, "events", d)


def _tagged(s, d):
    """Texts with and without tags, made from ids."""
    k = F.col("doc_id") % 5
    said = F.when(k == 0, "<BOOLEAN> True </BOOLEAN>").when(k == 1, "x <BOOLEAN>false</BOOLEAN>").when(k == 2, "<BOOLEAN> False, True </BOOLEAN>").when(k == 3, "<BOOLEAN> maybe").otherwise("none")
    return _docs(s, d).select("doc_id", said.alias("t"))


TAGGED = "(SELECT doc_id, ['<BOOLEAN> True </BOOLEAN>', 'x <BOOLEAN>false</BOOLEAN>', '<BOOLEAN> False, True </BOOLEAN>', '<BOOLEAN> maybe', 'none'][doc_id % 5 + 1] AS t FROM documents)"
WRAP_SQL = r"""'<FLOAT> ' || regexp_replace(substr(CASE WHEN contains(x, '-') THEN x ELSE '+' || x END, 1, 7), '(.)', '<|\1|>', 'g') || ' </FLOAT>'"""

QUERIES: dict[str, Query] = {
    "label_wrap_float": (
        lambda s, d: load(s, "customer", d).select("c_custkey", T.wrap_float(F.col("c_acctbal")).alias("label")),
        f"SELECT c_custkey, {WRAP_SQL} AS label FROM (SELECT c_custkey, printf('%.10f', c_acctbal) AS x FROM customer)",
    ),
    "label_wrap_boolean": (
        lambda s, d: load(s, "labels", d).select("doc_id", T.wrap_boolean(F.when(F.col("quality") == 1, "Yes").otherwise("FALSE")).alias("label")),
        "SELECT doc_id, '<BOOLEAN> ' || CASE quality WHEN 1 THEN 'True' ELSE 'False' END || ' </BOOLEAN>' AS label FROM labels",
    ),
    "label_wrap_names": (
        lambda s, d: load(s, "nation", d).groupBy("n_regionkey").agg(T.wrap_names(F.array_sort(F.collect_list("n_name"))).alias("label")),
        "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ', ') || ' <BOOLEAN> ' || array_to_string(list_transform(list(n_name), lambda x: 'True'), ', ') || ' </BOOLEAN>' AS label FROM nation GROUP BY n_regionkey",
    ),
    "parse_boolean_any": (
        lambda s, d: _tagged(s, d).select("doc_id", T.boolean_tag(F.col("t")).alias("said")),
        f"SELECT doc_id, {BOOL_SQL} AS said FROM (SELECT doc_id, CASE WHEN regexp_matches(t, '<BOOLEAN>.*</BOOLEAN>') THEN lower(trim(regexp_extract(t, '<BOOLEAN>(.*?)</BOOLEAN>', 1))) END AS m FROM {TAGGED})",
    ),
    "parse_float_tag": (
        lambda s, d: load(s, "customer", d).select("c_custkey", T.float_tag(T.wrap_float(F.col("c_acctbal"))).alias("x")),
        "SELECT c_custkey, CAST(substr(CASE WHEN c_acctbal < 0 THEN '' ELSE '+' END || printf('%.10f', c_acctbal), 1, 7) AS DOUBLE) AS x FROM customer",
    ),
    "parse_tag_open": (
        lambda s, d: _tagged(s, d).select("doc_id", T.tag_content_open(F.col("t"), "BOOLEAN").alias("said")),
        f"SELECT doc_id, CASE WHEN regexp_matches(t, '<BOOLEAN>.*</BOOLEAN>') THEN regexp_extract(t, '<BOOLEAN>(.*?)</BOOLEAN>', 1) WHEN contains(t, '<BOOLEAN>') THEN regexp_extract(t, '<BOOLEAN>(.*)', 1) END AS said FROM {TAGGED}",
    ),
    "parse_tag_closed": (
        lambda s, d: load(s, "pages", d).select("page_id", T.tag_content(F.col("html"), "h1").alias("title")),
        r"SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<h1>.*?</h1>') THEN regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '^\s+|\s+$', '', 'g') END AS title FROM pages",
    ),
    "strip_tags": (
        lambda s, d: load(s, "pages", d).select("page_id", F.md5(T.strip_tags(F.col("html"), "p", "b", "li").cast("binary")).alias("bare")),
        "SELECT page_id, md5(trim(regexp_replace(html, '</?(?:p|b|li)>', '', 'g'))) AS bare FROM pages",
    ),
    "strip_graph_block": (
        lambda s, d: load(s, "pages", d).select("page_id", F.length(T.strip_graph(F.regexp_replace("html", "(</?)nav>", "$1GRAPH>"))).alias("n")),
        "SELECT page_id, CAST(length(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g')) AS INTEGER) AS n FROM pages",
    ),
    "clean_separators": (
        lambda s, d: _orders(s, d).select("o_orderkey", T.clean_separators(F.concat_ws(" ; ", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("s")),
        "SELECT o_orderkey, o_orderstatus || '.' || o_orderpriority || '.' || o_custkey AS s FROM orders",
    ),
    "tag_rewrite": (
        lambda s, d: load(s, "part", d).select("p_partkey", T.retag(F.concat(F.lit("in <SMILES> "), F.col("p_name"), F.lit("</SMILES> and <SMILES><None></SMILES> end")), "SMILES", "SELFIES", F.upper).alias("t")),
        "SELECT p_partkey, 'in <SELFIES> ' || upper(trim(p_name)) || ' </SELFIES> and <SELFIES> <None> </SELFIES> end' AS t FROM part",
    ),
    "tag_spacing": (
        lambda s, d: load(s, "part", d).select("p_partkey", T.space_tags(F.concat(F.lit("<X>"), F.col("p_type"), F.lit("  </X>")), "X").alias("t")),
        "SELECT p_partkey, '<X> ' || trim(p_type) || ' </X>' AS t FROM part",
    ),
    "prompt_template": (
        lambda s, d: load(s, "benchmark", d).select("item_id", F.md5(T.prompt(F.col("text"), "Be brief.", "LLaDA-8B").cast("binary")).alias("llada"), F.md5(T.prompt(F.col("text"), "Be brief.", "mistral").cast("binary")).alias("other")),
        """SELECT item_id, md5('<|startoftext|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Be brief.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS llada,
        md5('<s>[INST] Be brief. ' || chr(10) || chr(10) || text || ' [/INST] ') AS other FROM benchmark""",
    ),
    "target_template": (
        lambda s, d: load(s, "region", d).select("r_regionkey", T.target(F.col("r_name"), "Llama-3").alias("a"), T.target(F.col("r_name"), "mistral").alias("b")),
        "SELECT r_regionkey, r_name || '<|eot_id|>' AS a, r_name || ' </s>' AS b FROM region",
    ),
    "fill_instruction": (
        lambda s, d: load(s, "nation", d).select("n_nationkey", F.md5(T.fill_instruction(F.when(F.col("n_nationkey") % 2 == 0, "Name <INPUT> now.").otherwise("Name it."), F.col("n_name")).cast("binary")).alias("p")),
        "SELECT n_nationkey, md5(CASE WHEN n_nationkey % 2 = 0 THEN 'Name ' || n_name || '<GRAPH>' || repeat('<mol>', 32) || '</GRAPH> now.' ELSE 'Name it.<GRAPH>' || repeat('<mol>', 32) || '</GRAPH>' END) AS p FROM nation",
    ),
    "plain_task": (
        lambda s, d: load(s, "nation", d).select("n_nationkey", T.plain_task(F.concat(F.col("n_name"), F.element_at(F.array(F.lit("/0"), F.lit("/multi_label_classification"), F.lit("/7")), F.col("n_nationkey") % 3 + 1))).alias("task")),
        "SELECT n_nationkey, n_name || CASE n_nationkey % 3 WHEN 2 THEN '/7' ELSE '' END AS task FROM nation",
    ),
    "data_tag": (
        lambda s, d: load(s, "nation", d).select("n_nationkey", T.data_tag(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")), F.col("n_regionkey") < 2).alias("tag")),
        "SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '_toy' || n_nationkey ELSE '' END || CASE WHEN n_regionkey < 2 THEN '' ELSE '_nodedup' END AS tag FROM nation",
    ),
    "levenshtein_mean": (
        lambda s, d: load(s, "customer", d).join(load(s, "nation", d), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.avg(F.levenshtein("c_mktsegment", "n_name")), 6).alias("mean")),
        "SELECT n_name, round(avg(levenshtein(c_mktsegment, n_name)), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "parse_key_values": (
        lambda s, d: _orders(s, d).select("o_orderkey", T.key_values(F.concat(F.lit("b=x,a="), F.col("o_orderstatus"), F.lit(",b="), F.col("o_custkey").cast("string"))).alias("m")).select("o_orderkey", F.col("m")["b"].try_cast("long").alias("b")),
        "SELECT o_orderkey, o_custkey AS b FROM orders",
    ),
    "parse_url": (
        lambda s, d: load(s, "pages", d).select("page_id", F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1).alias("last")),
        "SELECT page_id, string_split(split_part(url, '?', 1), '/')[-1] AS last FROM pages",
    ),
    "lenient_number": (
        lambda s, d: _events(s, d).select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS double)").alias("k"), F.expr("try_cast(event_type AS double)").alias("none")),
        "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events",
    ),
    "truth_string": (
        lambda s, d: load(s, "labels", d).select("doc_id", T.truth_string(F.element_at(F.array(F.lit("2.5"), F.lit("0"), F.lit(" Yes "), F.lit("no"), F.lit("TRUE")), (F.col("doc_id") % 5 + 1).cast("int"))).alias("t")),
        "SELECT doc_id, doc_id % 5 IN (0, 2, 4) AS t FROM labels",
    ),
    "metric_key_split": (
        lambda s, d: load(s, "nation", d).select("n_nationkey", T.metric_parts(F.concat(F.lit("val/a/"), F.col("n_name"), F.lit("/mae"))).alias("k")).select("n_nationkey", "k.*"),
        "SELECT n_nationkey, 'val' AS phase, 'a/' || n_name AS task, 'mae' AS metric FROM nation",
    ),
    "entity_key_groups": (
        lambda s, d: _docs(s, d).groupBy(F.md5(T.entity_key(F.col("text")).cast("binary")).alias("key")).agg(F.count("*").alias("n")).where("n > 1"),
        r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "json_round_trip": (
        lambda s, d: load(s, "nation", d).select("n_nationkey", F.from_json(F.to_json(F.struct("n_name", "n_regionkey")), "n_name string, n_regionkey int").alias("j")).select("n_nationkey", "j.*"),
        "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    ),
}
