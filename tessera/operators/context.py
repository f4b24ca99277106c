"""Context text within a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexical import token_estimate


@dataclass(frozen=True)
class ContextOptions:
    max_tokens: int = 1500
    template: str = "- [{kind}] {content} (score: {score:.2})"
    header: str | None = "### Relevant Agent Memories:"
    footer: str | None = None


def rendered(template: str) -> Column:
    """The template with {kind}, {content}, {score:.2} and {score} put in, in this order, each over what stands so far."""
    out = F.replace(F.lit(template), F.lit("{kind}"), F.col("kind"))
    out = F.replace(out, F.lit("{content}"), F.col("content"))
    out = F.replace(out, F.lit("{score:.2}"), F.format_string("%.2f", F.col("score").cast("double")))
    return F.replace(out, F.lit("{score}"), F.format_string("%.4f", F.col("score").cast("double")))


def estimate(text: str | None) -> int:
    return -(-len((text or "").encode()) // 4)


def format_context(items: DataFrame, o: ContextOptions = ContextOptions(), order: str = "rank") -> DataFrame:
    """One row: context, tokens, items. Lines come in order until one would exceed the budget; the footer only if it fits.

    items is a recall result, so at most the recall limit's rows."""
    head = f"{o.header}\n" if o.header else ""
    lines = items.select(F.col(order).alias("rn"), rendered(o.template).alias("line")).withColumn("tokens", token_estimate(F.col("line")))
    upto = F.sum("tokens").over(W.orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    kept = lines.withColumn("upto", upto + estimate(head)).where(F.col("upto") <= o.max_tokens)
    one = kept.agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("l"), F.coalesce(F.max("upto"), F.lit(estimate(head))).alias("tokens"), F.count(F.lit(1)).alias("items"))
    body = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    foot = o.footer or ""
    fits = F.lit(bool(foot)) & (F.col("tokens") + estimate(foot) <= o.max_tokens)
    return one.select(F.when(fits, F.concat(body, F.lit(foot))).otherwise(body).alias("context"), F.when(fits, F.col("tokens") + estimate(foot)).otherwise(F.col("tokens")).cast("long").alias("tokens"), "items")
