"""URL filters: rules first, then a naive Bayes judge over segmented names.

Host labels and the letters of paths are often words written together. A unigram Viterbi pass splits each distinct name
into the likeliest words, by the word counts of the pages' own text. Multinomial naive Bayes, trained on the pages that a
rule decides, then scores the words of host and path of all others.

Word counts, the words inside each name and the token counts are joins and aggregates; only the split of one name runs in
Python. Nothing is collected but the class totals.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import lower_ascii, stored

# fixed values: verdict, host, path of the rules
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Longest word that a name is split into, and the smoothing of the token counts.
LONGEST, SMOOTH = 20, 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for texts without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(F.coalesce(mark, F.lit(0)) > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Ties go to the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words that make up the name. Unknown stretches cost more with every character."""
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            cost = math.log(n / total) if n else -math.log(total + 2) - (end - start) * math.log(10)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the text between the tags of all pages; words of more than LONGEST letters never make part of a name."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for distinct names: each with the counts of its own parts only, which a join finds."""
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = names.select(
        "name",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.length("name")),
                        lambda i: F.transform(
                            F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - i + 1)), lambda n: F.substr(F.col("name"), i, n)
                        ),
                    )
                )
            )
        ).alias("word"),
    )
    known = parts.join(words, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([split_name(x, dict(c) if c is not None else {}, total) for x, c in zip(name, known, strict=True)])

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def _shape(text: Column) -> Column:
    """Letters in lower case; every number is the same; all else parts them."""
    return F.array_remove(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", " 0 "), r"[^\p{L}0]+", " "), " "), "")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) for every row of ``pages``.

    ``rule`` is the rule that decided, null where none fits; ``score`` is the judge's log odds of block and ``words`` the
    split host and path it saw. Without a rule the verdict is block for a positive score, else allow, ties included; the
    judge knows only pages that a rule decided, so without any all scores are 0. Rows are judged one by one: repeated rows
    and null ids are kept. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(
        rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.array_join(_shape(F.col("host")), " ").alias("h"),
                    F.array_join(_shape(F.col("path")), " ").alias("p")),
        "pages",
    )
    # hosts and shapes of paths are few beside the pages: all that follows works on the distinct ones
    texts = ruled.select(F.lit("h").alias("side"), F.col("h").alias("shape")).unionByName(ruled.select(F.lit("p").alias("side"), F.col("p").alias("shape"))).distinct()
    pieces = texts.where("shape <> ''").select("side", "shape", F.posexplode(F.split("shape", " ")).alias("at", "name"))
    names = pieces.select("name").where("name <> '0'").distinct()
    split = segmented(names, stored(word_counts(rows), "words"))
    tokens = stored(
        pieces.join(split, "name", "left")
        .select("side", "shape", "at", F.posexplode(F.coalesce("words", F.array("name"))).alias("k", "word"))
        .select("side", "shape", "at", "k", "word", F.concat_ws(":", "side", "word").alias("token")),
        "tokens",
    )
    seen = ruled.where("verdict is not null").groupBy("h", "p", "verdict").agg(F.count("*").alias("n"))
    sides = seen.select(F.lit("h").alias("side"), F.col("h").alias("shape"), "verdict", "n").unionByName(
        seen.select(F.lit("p").alias("side"), F.col("p").alias("shape"), "verdict", "n")
    ).groupBy("side", "shape").agg(F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow"))
    counted = tokens.join(sides, ["side", "shape"]).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counted = stored(counted, "token-counts")
    sums = counted.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*")).first()
    classes = {r["verdict"]: r["n"] for r in seen.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # two rows
    both = classes.get("block", 0) and classes.get("allow", 0)
    prior = math.log(classes["block"] / classes["allow"]) if both else 0.0
    weight = F.log((F.col("block") + SMOOTH) / (sums[0] + SMOOTH * (sums[2] + 1))) - F.log((F.col("allow") + SMOOTH) / (sums[1] + SMOOTH * (sums[2] + 1)))
    weights = counted.select("token", (weight if both else F.lit(0.0)).alias("weight"))
    scored = stored(
        tokens.join(weights, "token", "left").groupBy("side", "shape").agg(
            F.sum(F.coalesce("weight", F.lit(0.0)).cast("decimal(30,12)")).cast("double").alias("score"),
            F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "word"))), lambda x: x["word"]).alias("words"),
        ),
        "shapes",
    )
    of = lambda side: scored.where(F.col("side") == side).select(F.col("shape").alias(side), F.col("score").alias(f"score_{side}"), F.col("words").alias(f"words_{side}"))
    out = ruled.join(of("h"), "h", "left").join(of("p"), "p", "left")
    score = F.lit(prior) + F.coalesce("score_h", F.lit(0.0)) + F.coalesce("score_p", F.lit(0.0))
    none = F.array().cast("array<string>")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"), F.concat(F.coalesce("words_h", none), F.coalesce("words_p", none)).alias("words"),
    )
