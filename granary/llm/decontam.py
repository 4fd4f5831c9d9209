"""Benchmark decontamination over a stored positional inverted index, with DataFrame and SQL functions only.

The index is a table of postings ``(term, doc_id, pos)``. A phrase is found by its rarest terms: the lists of the two
rarest terms of each window are shifted by the terms' offsets and intersected, and only the alignments that survive are
intersected with the remaining lists.

Cases: null and word-less texts have no postings and length 0. For ``contamination`` every row is a document: repeated rows are
told apart, also where an id repeats, and a null id is reported as null. ``build_index`` by itself goes by ids: rows of one id are
laid over each other, and rows of none are left out. Items with a null id or no words are ignored; items of the same words share
their hits. Ties between equally rare terms go by place. A very long text is one row of words. Empty tables give empty results.
Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables up to this many rows of two or three short columns (some 100 bytes each) may be broadcast.
SMALL_ROWS = 200_000


def words(text: Column) -> Column:
    """The array of words of a text, A-Z lower-cased; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its row count is within the bound; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """Store and return the postings (term, doc_id, pos from 0, label); a document's length is the posting of the null term.

    With a ``vocabulary`` (term) only its terms get postings, which is exact for queries over those terms. A label goes along with
    the posting of the null term only.
    """
    label = F.lit(None).cast("long") if label_col is None else F.col(label_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), label.alias("label"), F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit(None).cast("string")))).alias("pos", "term")
    ).withColumn("label", F.when(F.col("term").isNull(), F.col("label")))
    if vocabulary is not None:
        known = vocabulary.select(F.col("term").alias("known")).distinct()
        rows = rows.join(_small(known), F.col("term") == F.col("known"), "left").where("known is not null or term is null").drop("known")
    return stored(rows.select("term", "doc_id", "pos", "label"), "postings")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, words, n) of the items that have words."""
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).withColumn("n", F.size("words")).where("n > 0")


def phrases(items: DataFrame, window: int) -> DataFrame:
    """One row per distinct word sequence: (phrase, words, n, span, item_ids); span is the length of its windows."""
    return (
        items.groupBy("words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .select(F.element_at("item_ids", 1).alias("phrase"), "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(window)).alias("span"), "item_ids")
    )


def _anchors(asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """(phrase, p1, t1, p2, t2): for each window the places of its two rarest terms; none for windows with an absent term."""
    placed = asked.select("phrase", "n", "span", F.posexplode("words").alias("p", "term")).join(frequency, "term", "left")
    lists = placed.groupBy("phrase", "n", "span").agg(F.sort_array(F.collect_list(F.struct("p", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("places"))
    windows = lists.select("phrase", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("span"))).alias("s"), "places", "span").select(
        "phrase", F.sort_array(F.transform(F.slice("places", F.col("s") + 1, F.col("span")), lambda x: F.struct(x.df.alias("df"), x.p.alias("p"), x.term.alias("term")))).alias("rare")
    )
    two = windows.where(F.col("rare")[0].df > 0).select("phrase", F.col("rare")[0].alias("a"), F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0]).alias("b"))
    return two.select("phrase", F.col("a.p").alias("p1"), F.col("a.term").alias("t1"), F.col("b.p").alias("p2"), F.col("b.term").alias("t2")).distinct()


def alignments(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(phrase, doc_id, shift): shifts at which the two rarest terms of some window both have a posting."""
    vocabulary = asked.select(F.explode("words").alias("term")).distinct()
    frequency = stored(index.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(vocabulary) if vocabulary.count() <= SMALL_ROWS else vocabulary, "term", "left_semi"), "frequency")
    anchors = stored(_anchors(asked, frequency), "anchors")
    both = anchors.select("phrase", "p1", "p2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("t1").alias("term"), F.col("p1").alias("p")), F.struct(F.lit(2).alias("side"), F.col("t2").alias("term"), F.col("p2").alias("p")))).alias("x"))
    lists = both.select("phrase", "p1", "p2", "x.*")
    shifted = index.join(_small(stored(lists, "lists")), "term").select("phrase", "doc_id", "p1", "p2", "side", (F.col("pos") - F.col("p")).alias("shift"))
    met = shifted.groupBy("phrase", "doc_id", "p1", "p2", "shift").agg(F.bit_or(F.col("side")).alias("sides")).where("sides = 3")
    return met.select("phrase", "doc_id", "shift").distinct()


def phrase_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(phrase, doc_id, pos): document words inside an occurrence of a window, by intersecting the remaining lists.

    On each surviving alignment the postings that agree with the phrase are laid in order; runs at least as long as the
    window are its occurrences.
    """
    found = stored(alignments(index, asked), "alignments")
    wanted = found.join(asked.select("phrase", "span", F.posexplode("words").alias("p", "term")), "phrase").select("phrase", "span", "doc_id", "shift", "p", "term", (F.col("shift") + F.col("p")).alias("pos"))
    some = index.where("term is not null").drop("label").join(_small(stored(found.select("doc_id").distinct(), "found")), "doc_id", "left_semi")
    agree = some.join(wanted, ["doc_id", "pos", "term"]).distinct()
    line = Window.partitionBy("phrase", "doc_id", "shift")
    runs = agree.withColumn("run", F.col("p") - F.row_number().over(line.orderBy("p")))
    return runs.withColumn("length", F.count("*").over(Window.partitionBy("phrase", "doc_id", "shift", "run"))).where("length >= span").select("phrase", "doc_id", "pos")


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(item_id, doc_id, pos): places of an item's rarest term that have all its other terms at most ``within`` words away.

    The lists meet on blocks of ``within + 1`` positions, so the join keys are equalities.
    """
    terms = items.select("item_id", F.explode(F.array_distinct("words")).alias("term"))
    listed = stored(terms.join(index.where("term is not null").groupBy("term").agg(F.count("*").alias("df")), "term", "left").na.fill(0, ["df"]), "terms")
    first = listed.groupBy("item_id").agg(F.min(F.struct("df", "term")).alias("r"), F.count("*").alias("n_terms")).where("r.df > 0").select("item_id", F.col("r.term").alias("rare"), "n_terms")
    block = F.lit(within + 1)
    starts = index.join(first, F.col("term") == F.col("rare")).select("item_id", "rare", "n_terms", "doc_id", F.col("pos").alias("at"), F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - within, F.lit(0)) / block), F.floor((F.col("pos") + within) / block))).alias("b"))
    near = index.join(listed.select("item_id", "term"), "term").withColumn("b", F.floor(F.col("pos") / block))
    met = starts.join(near, ["item_id", "doc_id", "b"]).where((F.abs(F.col("pos") - F.col("at")) <= within) & ((F.col("term") != F.col("rare")) | (F.col("pos") == F.col("at"))))
    return met.groupBy("item_id", "doc_id", "at", "n_terms").agg(F.count_distinct("term").alias("met")).where("met = n_terms").select("item_id", "doc_id", F.col("at").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, item_ids, contaminated); contaminated if ``n_hit > 0`` and ``share * n_hit >= n_words``."""
    asked = stored(phrases(item_words(benchmark), window), "phrases")
    # rows are told apart by a number that is stored with the postings, so that an id may repeat
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("label"), F.col(text_col).alias("text"))
    index = build_index(numbered, asked.select(F.explode("words").alias("term")), "row", "text", "label")
    hits = stored(phrase_hits(index, asked), "hits")
    counted = hits.groupBy("doc_id").agg(F.count_distinct("pos").alias("hit"))
    named = hits.select("doc_id", "phrase").distinct().join(asked.select("phrase", "item_ids"), "phrase").groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))
    lengths = index.where("term is null").select("doc_id", "label", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return (
        lengths.join(counted, "doc_id", "left")
        .join(named, "doc_id", "left")
        .select(F.col("label").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
    )
