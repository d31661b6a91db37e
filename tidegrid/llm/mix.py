"""Mixing sources to target shares of the total tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import tokens
from tidegrid.llm.encode import counted
from tidegrid.session import checkpointed, small_side


#: Documents of a source that share a key range, about.
RANGE_DOCS = 20_000


class Mix:
    """A mix of documents (doc_id, text, source) to the shares of targets (source, target_share, max_repeats).

    Target shares count among the sources that have tokens, scaled up to 1 where others have none. total_tokens is the size of the mix; without it, it is the largest for which no source needs a document more than max_repeats times. A total that a source can't fill within its repeats leaves that source short, which the report shows. Documents without a source or with one that has no target take no part; targets with a null source, a share of 0 or less, or fewer than 1 repeat have a budget of 0. Empty and null texts have 0 tokens and come along with their neighbours. Rows that repeat a doc_id are documents of their own.

    Each document gets a hash-random key. Within a source, documents are ordered by key: ranges of keys (buckets) have their token sums added up over the source, and each range adds up its own documents, so that no source, however large, is in one task. There are as many ranges as leave each about RANGE_DOCS documents of the largest source; the mix does not depend on their number. A source's budget is a number of whole epochs and a rest; the rest is the documents from the start of the order up to the cut nearest to it, which misses the budget by at most half a document.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, buckets: int | None = None, seed: int = 17, folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE):
        if buckets is not None and (buckets < 2 or buckets & (buckets - 1)):
            raise ValueError("buckets must be a power of two")
        t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        wanted = documents.select("doc_id", "text", "source").join(small_side(t.select("source")), "source", "left_semi")
        key = F.xxhash64("doc_id", F.lit(seed))
        sized = checkpointed(counted(wanted, ["doc_id", "source"], folder, name).withColumn("key", key))
        if buckets is None:
            most = sized.groupBy("source").count().agg(F.max("count")).head()[0] or 0
            buckets = 1 << max(4, (most // RANGE_DOCS).bit_length())
        self.buckets = buckets
        self.sized = sized.withColumn("bucket", F.shiftrightunsigned("key", 65 - buckets.bit_length()))
        sums = self.sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
        totals = sums.groupBy("source").agg(F.sum("tokens").alias("have"), F.sum("docs").alias("docs"))
        all_targets = Window.partitionBy(F.lit(1))  # as many rows as there are targets
        usable = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
        plan = t.join(totals, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("docs", F.lit(0)).alias("docs"))
        plan = plan.withColumn("share", F.when(usable, F.col("target_share")))
        plan = plan.withColumn("share", F.col("share") / F.sum("share").over(all_targets))
        reach = F.min(F.col("have") * F.col("max_repeats") / F.col("share")).over(all_targets)
        plan = plan.withColumn("total", reach if total_tokens is None else F.lit(float(total_tokens)))
        plan = plan.withColumn("budget", F.when(F.col("share").isNotNull(), F.least(F.round(F.col("share") * F.col("total")).cast("long"), F.col("have") * F.col("max_repeats"))).otherwise(F.lit(0)))
        plan = plan.withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(F.lit(0)))
        self.plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))

    def rows(self) -> DataFrame:
        """(doc_id, source, copy_no from 1, n_tokens, order_key): one row per use of a document; ordering by order_key interleaves the sources."""
        inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        docs = self.sized.withColumn("upto", F.sum("n_tokens").over(inside))
        docs = docs.join(small_side(self.offsets), ["source", "bucket"]).join(small_side(self.plan.select("source", "epochs", "rest", "max_repeats")), "source")
        middle = F.col("offset") + F.col("upto") - F.col("n_tokens") / 2
        copies = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("epochs") < F.col("max_repeats")) & (middle < F.col("rest")), 1).otherwise(0)
        docs = docs.withColumn("copies", copies.cast("int")).where("copies > 0")
        docs = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
        return docs.withColumn("order_key", F.xxhash64("doc_id", "copy_no"))

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, budget_tokens, available_tokens, available_docs, uses, most_repeats) of every target source; actual_share is null if the mix is empty."""
        used = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy_no").alias("most_repeats"))
        r = self.plan.join(used, "source", "left").select(
            "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("budget").alias("budget_tokens"), F.col("have").alias("available_tokens"), F.col("docs").alias("available_docs"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
        )
        everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
        return r.withColumn("actual_share", F.when(everything > 0, F.col("tokens") / everything))
