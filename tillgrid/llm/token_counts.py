"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Every document is encoded whole and only its length leaves the task. The
lengths are counted with partial aggregation, so a length that a third of
all documents share costs one row per task, and what remains is one row per
distinct length. Running sums over that histogram answer, for every context
limit, how many documents are longer, how many tokens all documents hold and
how many stay when each is cut at the limit.

Null and empty texts have length 0. An empty table gives no rows. Repeated
rows count once each. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents
from .tokens import RANKS, token_lengths, vocabulary_path

#: Lengths per block of the two-level running sums.
BLOCK = 64


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens``, ``n_docs``: documents by encoded length (written once; it is read several times)."""
    lengths = token_lengths(docs, path or vocabulary_path(RANKS))
    return cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit: exact totals.

    ``n_docs`` of that length; ``docs_at_least`` and ``tokens_at_least`` of
    that length or longer (suffix sums); ``docs_at_most``; ``total_tokens``
    of all documents; ``kept_tokens``, the sum of min(length, limit);
    ``quantile``, the share of documents of at most this length.
    Running sums go in two levels, inside blocks of 64 lengths and over
    the blocks' totals, so the one unpartitioned window holds a row per
    64 tokens of the longest document.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"),
                         (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(behind), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(behind), F.lit(0)).alias("t"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    sums = h.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("tokens").over(inside))
    out = sums.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("docs_in") + F.col("d")).alias("docs_at_least"),
        (F.col("tokens_in") + F.col("t")).alias("tokens_at_least"), "all_docs", "all_tokens")
    longer = F.col("docs_at_least")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - longer + F.col("n_docs")).alias("docs_at_most"), F.col("all_tokens").alias("total_tokens"),
        (F.col("all_tokens") - F.col("tokens_at_least") + longer * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("all_docs") - longer + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def truncated_totals(limits: DataFrame, contexts: Sequence[int]) -> DataFrame:
    """Tokens kept when every document is cut at each of ``contexts`` (any limits, not only lengths that occur)."""
    spark = limits.sparkSession
    sums = limits.agg(*[F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(int(c)))), F.lit(0)).alias(str(i))
                        for i, c in enumerate(contexts)]).first()
    return spark.createDataFrame([(int(c), int(sums[i])) for i, c in enumerate(contexts)], "context long, kept_tokens long")


def length_quantile(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return limits.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(documents(spark, sf_dir)))
