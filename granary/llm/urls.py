"""URL filters: host and path rules, else word segmentation and naive Bayes.

Names in hosts and paths are cut into words by unigram Viterbi: word counts are taken over the texts of all pages (map-side
combined) and of the labelled examples; only counts of substrings of names are joined to them, so no vocabulary is held in
memory. Multinomial naive Bayes, trained on ``EXAMPLES``, scores the words; it is a table of fixed size and stays JVM-side.
Segmenting and scoring are done once per distinct host and path skeleton (digits left out), then joined to the pages.

Cases: a null url, or one without ``://``, has empty host and path and no words, so no rule and the prior's verdict
(allow). Repeated rows are judged alike; a null html adds no counts; empty tables give empty results. Names of any length are split, since
Viterbi looks back ``LONGEST`` characters only. Of equally likely splits the one with the longer last word is taken; of two fitting rules the
longer, and two of one length can't both fit. Further columns come back as they are, under any names but those of the result, which replace them.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled names of sites, as words: general ones, none of them a host of the tables; tests judge names that aren't here.
EXAMPLES = {
    "block": (
        "sports bets", "best bets online", "casino bonus", "online casino", "live casino", "poker cash", "slots jackpot", "lottery win", "free spins", "gambling odds",
        "xxx adult video", "porn tube", "free porn", "sex chat", "sexy cams", "nude girls", "hot escorts", "diet pills", "viagra online", "cialis cheap", "pharmacy pills", "payday loans",
        "quick cash loans", "easy money", "crypto profit", "forex signals", "miracle weight loss", "replica watches", "cheap replica bags", "free download crack", "keygen warez", "serial crack",
        "torrent warez", "win free prize", "click here win", "hacked accounts", "buy followers", "spam offers", "malware download", "adult dating", "x rated",
        "spam sites", "spam mailer", "link farm", "content farm", "ads banner", "popup ads", "ad tracker", "click tracker", "track clicks", "adult toys", "x videos", "big win",
    ),
    "allow": (
        "news today", "daily news", "city news", "world report", "blog travel", "my blog", "food blog", "garden notes", "home garden", "science journal", "open science", "history archive",
        "public library", "digital library", "university press", "school learning", "math lessons", "language learning", "health clinic", "family doctor", "weather report", "local weather",
        "music review", "book review", "film review", "art museum", "national museum", "city council", "government services", "open data", "free software", "software docs", "developer guide",
        "code forum", "linux wiki", "wiki books", "recipe kitchen", "travel guide", "sports results", "football club", "photo gallery", "mobile page", "mail help", "shop store", "index page",
    ),
}
LONGEST = 20
#: A word of the examples counts as often as this in the unigram model.
EXAMPLE_WEIGHT = 1000
PRIOR_BLOCK = 0.4


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as host and path, its verdict); null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(below)
        name, verdict = F.when(fits, F.lit(at + below)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def bayes(examples: dict[str, tuple[str, ...]] = EXAMPLES) -> dict[str, float]:
    """Word -> log of its likelihood ratio of block to allow, with add-one smoothing; unseen words count nothing."""
    seen = {k: Counter(w for name in names for w in name.split()) for k, names in examples.items()}
    words = set(seen["block"]) | set(seen["allow"])
    total = {k: sum(c.values()) + len(words) for k, c in seen.items()}
    return {w: math.log((seen["block"][w] + 1) / total["block"]) - math.log((seen["allow"][w] + 1) / total["allow"]) for w in sorted(words)}


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name into words; an unknown string's probability falls tenfold with each character."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for stop in range(1, len(name) + 1):
        options = []
        for start in range(max(0, stop - LONGEST), stop):
            n = counts.get(name[start:stop], 0)
            p = math.log(n / total) if n else math.log(10 / total) - (stop - start) * math.log(10)
            options.append((best[start][0] + p, start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out, stop = [], len(name)
    while stop:
        start = best[stop][1]
        out.append(name[start:stop])
        stop = start
    return out[::-1]


def word_counts(pages: DataFrame, html_col: str = "html", examples: dict[str, tuple[str, ...]] = EXAMPLES) -> DataFrame:
    """(word, n) over the texts of all pages and the examples."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html_col), F.lit(""))), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    seen = Counter(w for names in examples.values() for name in names for w in name.split())
    more = pages.sparkSession.createDataFrame([(w, n * EXAMPLE_WEIGHT) for w, n in sorted(seen.items())], "word string, n long")
    return words.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name), distinct -> (name, words): unigram Viterbi over the counts of each name's own substrings."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    n = F.length("name")
    keyed = names.withColumn("_key", F.md5("name"))  # long names don't go along with each of their substrings
    starts = keyed.select("_key", "name", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    parts = starts.select("_key", F.explode(F.transform(F.sequence(F.lit(1), F.least(n - F.col("at") + 1, F.lit(LONGEST))), lambda k: F.substring(F.col("name"), F.col("at"), k))).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("_key").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches):
        for b in batches:
            found = [viterbi(name, {k["word"]: k["n"] for k in known or ()}, total) for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["name", "words"])

    return keyed.join(known, "_key", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, examples: dict[str, tuple[str, ...]] = EXAMPLES) -> DataFrame:
    """All columns but the html, then host, path, rule, verdict, words and score (log odds of block)."""
    taken = {c.lower() for c in pages.columns}
    skeleton = next(name for name in ("_" * k + "skeleton" for k in range(1, len(taken) + 2)) if name not in taken)
    keep = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict", "words", "score")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in keep], host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")).withColumn(skeleton, F.regexp_replace(F.lower("path"), r"[^\p{L}]+", "/"))
    kinds = stored(parsed.select("host", skeleton).distinct(), "skeletons")
    named = kinds.select("host", skeleton, F.explode(F.filter(F.split(F.concat_ws("/", "host", skeleton), r"[^\p{L}]+"), lambda w: w != "")).alias("name"))
    words = segment(named.select("name").distinct(), stored(word_counts(pages, html_col, examples), "words"))
    weights = bayes(examples)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    prior = math.log(PRIOR_BLOCK / (1 - PRIOR_BLOCK))
    split = named.join(words, "name").groupBy("host", skeleton).agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))
    scored = stored(split.withColumn("score", F.aggregate("words", F.lit(prior), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))), "scored")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    joined = parsed.join(scored, ["host", skeleton], "left")
    score = F.coalesce("score", F.lit(prior))
    verdict = F.coalesce(said, F.when(score > 0, "block").otherwise("allow"))
    return joined.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), score.alias("score"))
