"""Per-key results when a few keys hold most of the records (problem 4).

Everything is an algebraic aggregate, so Spark's own map-side hash aggregation does the
work: bounded per-task hash tables (they fall back to sorting and spilling when full)
hold mergeable key states, and only those partial states are shuffled. The first shuffle
is on (group, counted value), which spreads a hot group over all tasks and collapses its
repeats; what reaches the second is one partial count per task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.runtime import many_columns


def composite_key(fields: Column, available: Sequence[str], separator: str = "|") -> Column:
    """The values of the columns that the array ``fields`` names, in its order, joined.

    Null where the array is null, names a column that is not available, or any of the
    values is null. An empty array gives the empty text.
    """

    def value(field: Column) -> Column:
        out = F.lit(None).cast("string")
        for c in available:
            out = F.when(field == c, F.col(f"`{c}`").cast("string")).otherwise(out)
        return out

    values = F.transform(fields, value)
    return F.when(~F.exists(values, lambda v: v.isNull()), F.array_join(values, separator))


def count_distinct_per_key(rows: DataFrame, keys: Sequence[str], value: str, out: str = "n_distinct") -> DataFrame:
    """Distinct non-null ``value`` per combination of ``keys``; exact, whatever the skew.

    Null keys form a group of their own, repeated rows count once, an empty table gives no
    rows; columns beside keys and value are ignored.
    """
    once = rows.select(*keys, value).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("__one"))
    return once.groupBy(*keys).agg(F.count("__one").alias(out))


def meets(pattern: Column, n: Column) -> Column:
    """Whether the number ``n`` meets a count pattern such as ``>= 5``, ``=4`` or ``3``; null if it is none."""
    op = F.regexp_extract(pattern, r"^\s*(>=|<=|==|=|>|<)?\s*(\d+)\s*$", 1)
    least = F.regexp_extract(pattern, r"^\s*(>=|<=|==|=|>|<)?\s*(\d+)\s*$", 2).try_cast("bigint")
    return F.when(
        least.isNotNull(),
        F.when(op == ">=", n >= least).when(op == "<=", n <= least).when(op == ">", n > least).when(op == "<", n < least).otherwise(n == least),
    )


@many_columns()
def rule_groups(
    hits: DataFrame,
    rules: DataFrame,
    fields: Sequence[str] = ("computer", "target_user", "ip_address"),
    source: str = "source_file",
    document: str = "doc_no",
) -> DataFrame:
    """Groups of hits whose number of distinct documents meets their rule's count pattern.

    ``rules`` (rule_id, agg_count, agg_fields) is the small side; the optimiser broadcasts
    it only when its size is under the session's threshold and else shuffles on rule_id.
    Hits of a rule without aggregate, with a null among the rule's fields, or with a null
    document are not grouped; of several rows of one rule the least counts. Returns source, rule_id, key_text and n_docs.
    """
    wanted = (
        rules.where(F.col("agg_count").isNotNull() & F.col("agg_fields").isNotNull())
        .groupBy("rule_id")
        .agg(F.min(F.struct("agg_count", "agg_fields")).alias("__r"))
        .select("rule_id", "__r.agg_count", "__r.agg_fields")
    )
    narrow = hits.select(source, "rule_id", document, *fields)
    keyed = narrow.join(wanted, "rule_id").select(
        source, "rule_id", document, composite_key(F.col("agg_fields"), fields).alias("key_text")
    )
    counts = count_distinct_per_key(keyed.where(F.col("key_text").isNotNull()), [source, "rule_id", "key_text"], document, "n_docs")
    judged = counts.join(wanted.select("rule_id", "agg_count"), "rule_id")
    return judged.where(meets(F.col("agg_count"), F.col("n_docs"))).select(source, "rule_id", "key_text", "n_docs")
