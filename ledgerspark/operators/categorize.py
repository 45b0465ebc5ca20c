"""Keyword categorization.

Semantics: the first category (in rule order) having any keyword contained in the lowercase
merchant or lowercase description; otherwise ``misc``. An empty keyword matches everything.

Two physical forms with the same result, chosen by the number of keywords, which the caller gives:

* up to ``INDEX_FROM`` keywords, a ``CASE`` with one test per category: ``contains`` for a few keywords,
  else one ``rlike`` over the keywords as quoted alternatives (compiled once per task). It stays in
  whole-stage codegen and needs no join or shuffle.
* beyond, ``categorize_by_index``: every keyword is filed under the rarest of its q-grams, the distinct
  texts of the table look up theirs (an equi-join), and what meets is tested exactly. Its cost
  grows with the texts and with what they share with keywords, not with rows x keywords.

Texts and keywords are lower-cased by the same function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CATEGORY = "misc"
FEW = 8  # keywords of a category that are tested one by one
INDEX_FROM = 2000  # keywords from which on they are looked up in an index
GRAM = 4  # characters of a q-gram; shorter keywords are filed whole


def _normalize_rules(rules) -> list[tuple[str, list[str]]]:
    if isinstance(rules, dict):
        return [(str(k), [str(x) for x in (v or [])]) for k, v in rules.items()]
    return [(str(c), [str(x) for x in (kws or [])]) for c, kws in rules]


def _any_of(keywords: list[str]) -> Column:
    """A pattern that finds any of the keywords, lower-cased by Spark (folded to a literal)."""
    return F.lower(F.lit("|".join(re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", k) for k in keywords)))


def category_expr(rules, merchant: str = "merchant", description: str = "description",
                  default: str = DEFAULT_CATEGORY) -> Column:
    """F1 as a Column."""
    name = F.lower(F.coalesce(F.col(merchant), F.lit("")))
    desc = F.lower(F.coalesce(F.col(description), F.lit("")))
    expr = None
    for category, keywords in _normalize_rules(rules):
        if not keywords:
            continue
        found = F.lit("" in keywords)
        if not keywords or "" in keywords:
            pass
        elif len(keywords) <= FEW:
            for k in keywords:
                found = found | name.contains(F.lower(F.lit(k))) | desc.contains(F.lower(F.lit(k)))
        else:
            found = F.rlike(name, _any_of(keywords)) | F.rlike(desc, _any_of(keywords))
        expr = F.when(found, F.lit(category)) if expr is None else expr.when(found, F.lit(category))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def categorize(df: DataFrame, rules, merchant: str = "merchant", description: str = "description",
               out: str = "category", default: str = DEFAULT_CATEGORY) -> DataFrame:
    if sum(len(k) for _, k in _normalize_rules(rules)) > INDEX_FROM:
        return categorize_by_index(df, rules, merchant, description, out, default)
    return df.withColumn(out, category_expr(rules, merchant, description, default))


def _grams(text: Column, size: int) -> Column:
    """The distinct q-grams of one size of a text (none where it is shorter)."""
    last = F.length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(size)))))


def keyword_index(df: DataFrame, rules) -> DataFrame:
    """``(gram, keyword, rank)``: every keyword in lower case with the rank of its first category, filed
    under one of its q-grams: the one that fewest keywords hold. ``df`` only names the session."""
    rows = [(rank, k) for rank, (_, keywords) in enumerate(_normalize_rules(rules)) for k in keywords if k]
    words = (df.sparkSession.createDataFrame(rows, "rank INT, keyword STRING")
             .groupBy(F.lower("keyword").alias("keyword")).agg(F.min("rank").alias("rank")))
    short = F.length("keyword") < GRAM
    held = words.select("keyword", "rank", F.explode(F.when(short, F.array("keyword")).otherwise(_grams(F.col("keyword"), GRAM))).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return (held.join(often, "gram").groupBy("keyword")
            .agg(F.min("rank").alias("rank"), F.min(F.struct("n", "gram")).alias("least")).select("least.gram", "keyword", "rank"))


def categorize_by_index(df: DataFrame, rules, merchant: str = "merchant", description: str = "description",
                        out: str = "category", default: str = DEFAULT_CATEGORY) -> DataFrame:
    """F1 through the keyword index. Every distinct merchant and description is looked up once; its
    lowest rank goes back to the rows by equi-joins, in which AQE splits a text that many rows hold."""
    rules = _normalize_rules(rules)
    everything = min([r for r, (_, keywords) in enumerate(rules) if "" in keywords], default=len(rules))
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    index = keyword_index(df, rules)
    sizes = range(min([len(k) for _, keywords in rules for k in keywords if k] + [GRAM]), GRAM + 1)  # lower case never shortens
    texts = df.select(F.explode(F.array(lower(merchant), lower(description))).alias("text")).distinct()
    grams = F.flatten(F.array(*[F.coalesce(_grams(F.col("text"), n), F.array().cast("array<string>")) for n in sizes]))
    ranks = (texts.select("text", F.explode(grams).alias("gram")).join(index, "gram")
             .filter(F.col("text").contains(F.col("keyword"))).groupBy("text").agg(F.min("rank").alias("rank")))
    found = df.withColumn("__m", lower(merchant)).withColumn("__d", lower(description))
    for side in ("__m", "__d"):
        found = found.join(ranks.select(F.col("text").alias(side), F.col("rank").alias(f"{side}_rank")), side, "left")
    rank = F.least(F.col("__m_rank"), F.col("__d_rank"), F.lit(everything))
    names = F.array(*[F.lit(c) for c, _ in rules], F.lit(default))
    columns = df.columns if out in df.columns else [*df.columns, out]
    return found.withColumn(out, F.element_at(names, rank + 1)).select(*columns)
