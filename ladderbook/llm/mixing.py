"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree of domains, languages and sources. The budget of tokens is parted among the
domains by weight, each domain's share among its languages, and so on. A node cannot take more than
its documents give in the allowed epochs; what it falls short by goes to its siblings, by weight, and
only what they cannot take either goes to the siblings of its parent. A leaf's budget buys whole
epochs, and from the next one the prefix that still fits, in the order of a seeded hash.

Budgets are exact integers. An epoch's prefix is found by sums over slices of the hash, so that only
the slice in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLICES = 3  # hex digits of the hash that make a slice: 4096 slices of a leaf
_BIG = "decimal(38,0)"


def _parted(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (…parent, name, cap, weight, budget: the parent's) with share: what each child gets of it."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast(_BIG)
    cap, weight, budget = (F.col(c).cast(_BIG) for c in ("cap", "weight", "budget"))
    filled = cap * F.sum("weight").over(after).cast(_BIG) <= weight * (budget - F.coalesce(F.sum("cap").over(before).cast(_BIG), zero))
    nodes = nodes.withColumn("_filled", filled)
    all_of = Window.partitionBy(*parent)
    rest = budget - F.coalesce(F.sum(F.when(F.col("_filled"), F.col("cap"))).over(all_of).cast(_BIG), zero)
    open_weight = F.sum(F.when(~F.col("_filled"), F.col("weight"))).over(all_of)
    nodes = nodes.withColumns({"_rest": rest.cast("bigint"), "_open": open_weight})
    share = F.expr("cast((cast(_rest as decimal(20,0)) * weight) div _open as bigint)")
    return nodes.withColumn("share", F.when(F.col("_filled"), F.col("cap")).otherwise(share)).drop("_filled", "_rest", "_open", "budget")


def budgets(leaves: DataFrame, total: Column, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens, dw, lw, sw: the levels' weights) with budget and what it buys.

    total: the budget in tokens, an expression over `tokens`, the sum of all leaves.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.max("lw").alias("weight"), F.max("dw").alias("dw"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.max("dw").alias("weight"))
    top = domains.withColumn("root", F.lit(0)).withColumn("tokens", F.sum("tokens").over(Window.partitionBy("root")))  # one row a domain
    domains = _parted(top.withColumn("budget", total.cast("bigint")), ["root"], "domain").select("domain", F.col("share").alias("budget"))
    langs = _parted(langs.drop("dw", "tokens").join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    parted = _parted(leaves.withColumn("weight", F.col("sw")).join(langs, ["domain", "lang"]), ["domain", "lang"], "source")
    one = F.greatest(F.col("tokens"), F.lit(1))
    return parted.select("domain", "lang", "source", "tokens", F.col("share").alias("budget")).withColumns({"whole": F.expr("budget div greatest(tokens, 1)"), "rest": F.col("budget") % one})


def weight_of(column: str, weights: dict[str, int], other: int) -> Column:
    """A node's weight by its name; positive integers."""
    found = F.lit(other)
    for name, w in weights.items():
        found = F.when(F.col(column) == name, w).otherwise(found)
    return found.cast("bigint")


def mix(docs: DataFrame, total: Column, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", domain: Column | None = None, lang: Column | None = None, source: Column | None = None, tokens: Column | None = None, weights: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """One row for each time that a document is taken: the id, domain, lang, source, n_tokens, epoch (from 0).

    domain, lang, source: the document's place in the tree (null counts as ''). tokens: its size;
    as default the UTF-8 bytes by four, rounded up (null text: 0). weights: by level, positive integers
    over the columns domain, lang, source; 1 as default. total: the budget, over `tokens` (all there are).

    A prefix never exceeds what is left of its leaf's budget; rows of one id (or of null ids) in a leaf
    stand at one place and are taken together. Rounding leaves less than a token a child unspent.
    """
    one = F.lit(1).cast("bigint")
    size = tokens if tokens is not None else F.expr("(coalesce(octet_length(text), 0) + 3) div 4")
    place = {"domain": domain if domain is not None else F.lit(""), "lang": lang if lang is not None else F.col("lang"), "source": source if source is not None else F.col("source")}
    lean = docs.select(F.col(id_col).cast("bigint").alias("_id"), size.cast("bigint").alias("n_tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in place.items()])
    lean = written(lean, "mixing")
    leaf = ["domain", "lang", "source"]
    dw, lw, sw = weights or (one, one, one)
    leaves = lean.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).withColumns({"dw": dw, "lw": lw, "sw": sw})
    bought = written(budgets(leaves, total, epochs).select(*leaf, "whole", "rest"), "budgets")
    text = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    hashed = lean.join(bought, leaf).withColumn("_spot", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), text)))
    hashed = hashed.withColumn("_slice", F.substring("_spot", 1, SLICES))
    sums = hashed.groupBy(*leaf, "_slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("_slice")
    sums = sums.withColumn("upto", F.sum("n").over(run)).select(*leaf, "_slice", (F.col("upto") - F.col("n")).alias("before"), (F.col("upto") <= F.col("rest")).alias("all"))
    placed = hashed.join(sums, [*leaf, "_slice"])
    clear = placed.filter("all or before > rest").withColumn("taken", F.when(F.col("all"), 1).otherwise(0))
    inside = Window.partitionBy(*leaf, "_slice").orderBy("_spot")
    split = placed.filter("not all and before <= rest").withColumn("taken", F.when(F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest"), 1).otherwise(0))
    times = clear.unionByName(split).withColumn("times", F.col("whole") + F.col("taken")).filter("times > 0")
    return times.select(F.col("_id").alias(id_col), *leaf, "n_tokens", F.explode(F.expr("sequence(0, cast(times as int) - 1)")).alias("epoch"))
