"""Mixing sources to target shares of a total size measured in tokens."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.tokens import count_tokens
from tertulia.operators.intervals import CHUNK_KEY, with_carry
from tertulia.operators.sizes import small_side
from tertulia.session import checkpointed

#: Bits of the hash key, and documents of a source that a chunk of the prefix sums has on average at most.
KEY_BITS, CHUNK_DOCUMENTS = 32, 4_096


def chunk_shift(documents: int) -> int:
    """The low bits of the key that a chunk leaves out, so that the largest source's chunks have CHUNK_DOCUMENTS at most on average."""
    return KEY_BITS - max(0, ceil(log2(max(1, documents) / CHUNK_DOCUMENTS)))


def _hash_key(doc: str, seed: int) -> Column:
    """A random-looking key of KEY_BITS bits, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc)), F.lit(2**KEY_BITS))


def _sized(documents: DataFrame, vocabulary: str | None) -> DataFrame:
    """(doc_id, source, n_tokens), one row a doc_id that has tokens and a source."""
    counted = count_tokens(documents, ["doc_id", "source"], vocabulary)
    return (
        counted.where((F.col("n_tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "n_tokens")).alias("_d"))
        .select("doc_id", "_d.*")
    )


def _targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row a source with a share and a repeat above 0."""
    return (
        targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.min(F.struct("target_share", "max_repeats")).alias("_t"))
        .select("source", "_t.*")
    )


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, epochs, rest): whole passes over a source and what is left of its budget.

    Shares of sources without documents go to the others in proportion. The total is the
    largest at which no source needs more than max_repeats passes, or total_tokens if less.
    """
    everything = Window.partitionBy(F.lit(0))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    met = have.join(small_side(_targets(targets)), "source").withColumn("_share", F.col("target_share") / F.sum("target_share").over(everything))
    total = F.min(F.col("available") * F.col("max_repeats") / F.col("_share")).over(everything)
    if total_tokens is not None:
        total = F.least(total, F.lit(float(total_tokens)))
    # the source that sets the total needs all its passes: its budget must not be rounded down
    budget = F.least(F.round(total * F.col("_share")).cast("bigint"), F.col("available") * F.col("max_repeats"))
    planned = met.withColumn("_budget", budget).withColumn("epochs", F.expr("_budget div available"))
    return planned.withColumn("rest", F.col("_budget") - F.col("epochs") * F.col("available")).drop("_budget", "_share")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the chosen documents and how many times each is used.

    A source whose budget is k times its tokens and a rest has each document k times, and once
    more those that come first in hash order, up to the rest: the cut is where the prefix sum of
    tokens is nearest to the budget, so a source is off by at most half a document. Prefix sums
    run in chunks of the key, so a source that has a third of all rows is no task of its own.

    Documents without tokens (null, empty), without a source or without a target are not
    chosen; a doc_id given twice counts once; extra columns are ignored; an empty table
    gives no rows. Ties of the key are broken by doc_id. Texts are encoded once: ids, sources and
    sizes are written to the checkpoint folder before sums and prefix sums read them.
    """
    sized = checkpointed(_sized(documents, vocabulary))
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    plan = small_side(_plan(sized, targets, total_tokens).select("source", "max_repeats", "epochs", "rest"))
    keyed = sized.join(plan, "source").withColumn("_key", _hash_key("doc_id", seed)).withColumn("_chunk", F.shiftright("_key", chunk_shift(most)))
    within = Window.partitionBy(CHUNK_KEY).orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    carried = with_carry(keyed, ["source"], "_chunk", {"size": F.sum("n_tokens")}, {"_offset": F.sum("size")})
    before = F.coalesce("_offset", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    extra = ((2 * before + F.col("n_tokens") <= 2 * F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))).cast("int")
    return carried.withColumn("repeats", F.col("epochs").cast("int") + extra).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_draws, n_tokens, actual_share, most_repeats) of every target source.

    Sources of which nothing was chosen have 0; of an empty mix every actual_share is 0.
    """
    got = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum("repeats").alias("n_draws"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    everything = Window.partitionBy(F.lit(0))
    all_targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("_t")).select("source", "_t.*")
    joined = all_targets.join(got, "source", "left").na.fill(0, ["n_docs", "n_draws", "n_tokens", "most_repeats"])
    total = F.sum("n_tokens").over(everything)
    share = F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "n_docs", "n_draws", "n_tokens", share.alias("actual_share"), "most_repeats")
