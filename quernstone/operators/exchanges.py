"""Exchanges: pairing of user and assistant messages, part links, ordered reads.

messages: (session, turn, role, text). Other roles than user and assistant take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_exchange(messages: DataFrame) -> DataFrame:
    """messages of people and assistants with the number of their exchange: each user message begins one."""
    begun = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("session").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow))
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("exchange", begun)


def pair(messages: DataFrame) -> DataFrame:
    """(session, exchange, user_text, final_text, n_assistant, status): a final answer is the last assistant message."""
    grouped = with_exchange(messages).where("exchange > 0").groupBy("session", "exchange").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"),
        F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
    )
    status = F.when(F.col("n_assistant") == 0, "unpaired").when(F.col("n_assistant") == 1, "paired").otherwise("ambiguous")
    return grouped.select("session", "exchange", "user_text", F.col("last.text").alias("final_text"), "n_assistant", status.alias("status"))


def part_links(parts: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """parts with previous_part_id and next_part_id inside each group."""
    w = W.partitionBy(*group).orderBy(order)
    return parts.withColumn("previous_part_id", F.lag(name).over(w)).withColumn("next_part_id", F.lead(name).over(w))


def counterparts(items: DataFrame) -> DataFrame:
    """(item_id, counterpart_item_ids): parts of the other role of the same exchange, in order."""
    other = items.select("session", "exchange", F.col("role").alias("r"), F.struct(F.col("part").alias("p"), F.col("item_id").alias("i")).alias("x"))
    met = items.join(other, ["session", "exchange"]).where("role <> r").groupBy("item_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return met.select("item_id", F.transform("x", lambda v: v["i"]).alias("counterpart_item_ids"))


def seed_order(members: DataFrame, seed: Column) -> DataFrame:
    """members with the order in which they are read around a seed: nearest first, later ones first on ties."""
    return members.withColumn("priority", F.row_number().over(W.partitionBy("session").orderBy(F.abs(F.col("pos") - seed), F.desc("pos"))))


def prefix_within(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs stay within the budget."""
    used = F.sum(cost).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def out_of_order(rows: DataFrame, group: str, order: str, time: str) -> DataFrame:
    """(group, n): how often time goes back within a group."""
    back = F.col(time) < F.lag(time).over(W.partitionBy(group).orderBy(order))
    return rows.select(group, back.alias("back")).groupBy(group).agg(F.count_if("back").alias("n"))


def common_prefix(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent, shared, delta): equal leading exchanges of a fork and its parent, and how many the fork adds.

    children: (child, parent, ordinal, digest); parents: (parent, ordinal, digest). The prefix ends before the first
    ordinal at which the digests differ or the parent has none.
    """
    met = children.join(parents.withColumnRenamed("digest", "theirs"), ["parent", "ordinal"], "left")
    first_miss = F.min(F.when(~F.col("digest").eqNullSafe(F.col("theirs")), F.col("ordinal")))
    counted = met.groupBy("child", "parent").agg(first_miss.alias("miss"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("low"))
    shared = F.coalesce(F.col("miss") - F.col("low"), F.col("n"))
    return counted.select("child", "parent", shared.cast("long").alias("shared"), (F.col("n") - shared).cast("long").alias("delta"))


def occurrences(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with occurrence: how often the group came so far."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(*group).orderBy(order)).cast("long"))


def bundle_order(messages: DataFrame) -> DataFrame:
    """Messages of exchanges with place: people first, then answers, in order."""
    rows = with_exchange(messages).where("exchange > 0")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session", "exchange").orderBy(F.desc("role"), "turn")).cast("long"))
