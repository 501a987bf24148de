"""Word lists learned from a corpus: what stands small wherever it stands is no name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import applied


def word_cases(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, docs, small, inside)`` of each word of two ASCII letters or more, in small letters.

    Words are what stands between white space, without signs behind them.
    ``docs`` counts the rows that have a word, ``small`` those in which it
    stands in small letters, ``inside`` those in which it stands with a capital
    behind a small letter or a comma, where no sentence begins. A row counts
    once for each, so long and repetitive texts weigh no more; a null text has
    no word.
    """
    found = "transform(a.t, (x, i) -> named_struct('w', regexp_extract(x, '^([A-Za-z]{2,})[^A-Za-z]*$', 1), 'p', if(i = 0, '', a.t[i - 1])))"
    noted = "named_struct('word', lower(x.w), 'small', x.w rlike '^[a-z]+$', 'inside', x.w rlike '^[A-Z][a-z]+$' and x.p rlike '[a-z,]$')"
    words = applied(f"array_distinct(transform(filter({found}, x -> x.w <> ''), x -> {noted}))", t=F.split(F.col(f"`{text_col}`"), "[ \n\t]+"))
    # Three lists of distinct words for each row, so that counts are sums and no row meets another.
    of = lambda test: F.array_distinct(F.transform(F.filter("found", test), lambda w: w["word"]))
    lists = docs.select(words.alias("found")).select(of(lambda w: F.lit(True)).alias("docs"), of(lambda w: w["small"]).alias("small"), of(lambda w: w["inside"]).alias("inside"))
    kinds = ("docs", "small", "inside")
    marked = lambda kind: applied(f"transform(coalesce(a.ws, array()), w -> named_struct('word', w, 'kind', '{kind}'))", ws=F.col(kind))
    each = F.concat(*map(marked, kinds))
    rows = lists.select(F.explode(each).alias("w")).select("w.word", "w.kind")
    return rows.groupBy("word").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def learned_jargon(docs: DataFrame, text_col: str = "text", least_docs: int = 3, most_inside: float = 0.2) -> DataFrame:
    """``(word)``: words of at least ``least_docs`` rows that stand with a capital inside a sentence in few of those that have them small.

    The list is a table: filter it, and pass it as ``Vocabulary.jargon`` where it is of a size for a plan.
    """
    counted = word_cases(docs, text_col)
    return counted.filter((F.col("docs") >= least_docs) & (F.col("small") > 0) & (F.col("inside") <= most_inside * F.col("small"))).select("word")
