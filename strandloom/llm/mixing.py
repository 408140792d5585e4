"""Mixing sources to target weights by hierarchical budgeting; native DataFrame operations only.

A token budget flows down a tree of domains, languages and sources.  Among
siblings it is split by weight, but no child gets more than its subtree can give
(its tokens times ``max_epochs``): what a child cannot use goes to its siblings
first and leaves the parent only if the whole family is exhausted.  Each leaf then
takes a prefix of its documents, ordered by a seeded hash, epoch after epoch.

The split among siblings is the exact water level, found with window sums over
the small tree table.  A leaf's prefix is found without sorting the leaf in one
task: documents fall into hash buckets, sums per bucket locate the bucket in
which the budget ends, and only that bucket's rows are ordered.  The prefix is
then one cut-off key per leaf, so that no text is shuffled and a leaf that holds
a third of all rows stays spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, with_lookup

#: Hex digits of the order key that name a bucket (16**n buckets a leaf).
BUCKET_DIGITS = 3
#: Weight of a node that the caller's mapping does not name.
DEFAULT_WEIGHT = 100
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def default_domain(source: Column) -> Column:
    """Sources are dealt to four domains by the first number in their name (none: 0)."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1).try_cast("long")
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(n, F.lit(0)), F.lit(4)).cast("string"))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(int(v))).otherwise(out)
    return out.cast("long")


def water_level(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Split ``family_budget`` over the children of each family (``name, weight, capacity``): adds ``budget``.

    Children are met in the order of capacity per weight.  One is full if its share by weight, of what
    is left and among those not yet met, is at least its capacity.  The others share the rest by weight,
    rounded down.  A child of weight 0 gets nothing.
    """
    w = W.partitionBy(*family).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), F.col(name))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = (nodes.where("weight > 0")
         .withColumn("_spent", F.coalesce(F.sum("capacity").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_open", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("_rest", F.greatest(F.col("family_budget") - F.col("_spent"), F.lit(0)))
         .withColumn("_full", F.expr("cast(capacity as decimal(20,0)) * cast(_open as decimal(18,0)) "
                                     "<= cast(_rest as decimal(20,0)) * cast(weight as decimal(18,0))"))
         .withColumn("_full", F.min("_full").over(w.rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_level", F.first(F.when(~F.col("_full"), F.struct("_rest", "_open")), ignorenulls=True).over(whole))
         .withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr(
             "cast((cast(_level._rest as decimal(20,0)) * cast(weight as decimal(18,0))) div cast(_level._open as decimal(18,0)) as bigint)"))))
    return x.drop("_spent", "_open", "_rest", "_full", "_level")


def allocate(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Budgets of the leaves (``domain, lang, source, tokens``), level by level from the root."""
    tree = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            nodes = nodes.withColumn("_root", F.lit(0)).withColumn("family_budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above, path[:-1])
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        above = water_level(nodes, path[:-1] or ["_root"], level).select(*path, F.col("budget").alias("family_budget"))
    return leaves.join(above, list(LEVELS)).withColumnRenamed("family_budget", "budget")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _leaf_columns(docs: DataFrame, domain) -> list[Column]:
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("lang", "source"))
    return [domain(F.col("`source`").cast("string")).alias("domain"), lang.alias("lang"), source.alias("source")]


def plan_mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], *, budget_permille: int = 600,
             max_epochs: int = 2, seed: int = 7, domain=default_domain) -> tuple[DataFrame, DataFrame, int]:
    """(narrow document rows, one row per leaf with its quota and cut-off key, number of leaves)."""
    rows = materialize(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), *_leaf_columns(docs, domain),
                                   token_count(F.col("`text`").cast("string")).alias("n_tokens")), "mix-rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    quota = allocate(leaves, total["t"] * budget_permille // 1000, weights, max_epochs)
    quota = materialize(quota.select(
        *LEVELS, "budget",
        F.expr("if(tokens > 0, budget div tokens, 0)").cast("long").alias("full_epochs"),
        F.expr("if(tokens > 0, budget % tokens, 0)").cast("long").alias("rest")).withColumn("leaf", F.struct(*LEVELS)), "mix-quota")

    small = quota.select("leaf", "full_epochs", "rest")
    keyed = (with_lookup(rows.select(F.struct(*LEVELS).alias("leaf"), "doc_id", "n_tokens"), small, "leaf", total["n"], 200)
             .where("rest > 0").withColumn("key", order_key(F.col("doc_id"), F.col("full_epochs"), seed))
             .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    sums = keyed.groupBy("leaf", "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy("leaf").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = (sums.withColumn("to", upto).withColumn("start", F.col("to") - F.col("n"))
            .where("start < rest and rest <= to").select("leaf", "bucket", "start"))
    inside = keyed.join(edge, ["leaf", "bucket"])
    inside = inside.groupBy("leaf", "rest", "start", "key").agg(F.sum("n_tokens").alias("n"))
    before = F.col("start") + F.sum("n").over(W.partitionBy("leaf").orderBy("key")) - F.col("n")
    cut = (inside.withColumn("before", before).where("before < rest")
           .groupBy("leaf").agg(F.max("key").alias("cut_key")))
    return rows, materialize(quota.join(cut, "leaf", "left"), "mix-cuts"), total["n"]


def _copies(seed: int) -> Column:
    key = order_key(F.col("doc_id"), F.col("full_epochs"), seed)
    last = F.when(F.col("cut_key").isNotNull() & (key <= F.col("cut_key")), 1).otherwise(0)
    return (F.coalesce(F.col("full_epochs"), F.lit(0)) + last).cast("long")


def mix_counts(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], *, seed: int = 7, **options) -> DataFrame:
    """How often the mixture takes each document: ``doc_id, domain, lang, source, n_tokens, copies``.

    ``copies`` is the number of epochs whose prefix holds the document; 0 if the mixture leaves it out.
    The document in which a leaf's budget ends is taken whole.  Rows with the same id in a leaf have
    the same place in the order and enter together.  Null ``lang`` or ``source`` is the empty name, a
    null text has no tokens (such documents cost nothing and follow their place in the order), an
    empty table gives an empty result.  Other columns are ignored.
    """
    rows, cuts, n = plan_mix(docs, weights, seed=seed, **options)
    small = cuts.select("leaf", "full_epochs", "cut_key")
    x = with_lookup(rows.withColumn("leaf", F.struct(*LEVELS)), small, "leaf", n, 200)
    return x.select("doc_id", *LEVELS, "n_tokens", _copies(seed).alias("copies"))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], *, seed: int = 7, domain=default_domain,
        **options) -> DataFrame:
    """The mixture's rows with all columns of ``docs``; a document taken in k epochs comes k times."""
    _, cuts, n = plan_mix(docs, weights, seed=seed, domain=domain, **options)
    small = cuts.select(F.col("leaf").alias("_leaf"), "full_epochs", "cut_key")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*cols).alias("_row"), F.struct(*_leaf_columns(docs, domain)).alias("_leaf"),
                         F.col("`doc_id`").cast("long").alias("doc_id"))
    x = with_lookup(packed, small, "_leaf", n, 200).select("_row", _copies(seed).alias("_copies")).where("_copies > 0")
    return x.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


#: The production mixture of the registered query.
WEIGHTS = {
    "domain": {"domain0": 400, "domain1": 300, "domain2": 200, "domain3": 100},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {},
}


def oracle_sql(budget_permille: int = 600, max_epochs: int = 2, seed: int = 7, weights=WEIGHTS) -> str:
    """DuckDB SQL of :func:`mix_counts` on the table ``documents``."""
    def case(level: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights[level].items())
        return f"CASE {level} {arms} ELSE {DEFAULT_WEIGHT} END" if arms else str(DEFAULT_WEIGHT)

    steps = []
    for depth, level in enumerate(LEVELS):
        path, family = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {family}" if family else ""
        source = (f"SELECT {path}, CAST(sum(tokens) * {max_epochs} AS HUGEINT) AS capacity FROM leaves GROUP BY {path}")
        budget = f"b{depth - 1}.budget" if depth else f"(SELECT sum(tokens) * {budget_permille} // 1000 FROM leaves)"
        join = f"JOIN b{depth - 1} USING ({family})" if depth else ""
        order = f"{part} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {level}"
        steps.append(f"""
n{depth} AS (SELECT n.*, {budget} AS family_budget, CAST({case(level)} AS HUGEINT) AS weight FROM ({source}) n {join}),
s{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n{depth} WHERE weight > 0),
f{depth} AS (SELECT *, greatest(family_budget - spent, 0) AS rest,
  min(CAST(capacity * open <= greatest(family_budget - spent, 0) * weight AS INT)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_now FROM s{depth}),
g{depth} AS (SELECT *, max(CASE WHEN full_now = 0 THEN open END) OVER ({part}) AS level_open,
  arg_max(rest, CASE WHEN full_now = 0 THEN open END) OVER ({part}) AS level_rest FROM f{depth}),
b{depth} AS (SELECT {path}, CASE WHEN full_now = 1 THEN capacity ELSE level_rest * weight // level_open END AS budget FROM g{depth})""")
    return f"""
WITH raw AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  'domain' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d{{1,9}})', 1) AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM raw GROUP BY domain, lang, source),
{",".join(steps)},
quota AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves l JOIN b2 USING (domain, lang, source)),
keyed AS (SELECT raw.*, coalesce(full_epochs, 0) AS full_epochs, coalesce(rest, 0) AS rest,
  md5('{seed}:' || CAST(full_epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM raw LEFT JOIN quota USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key)
  - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens,
  CAST(full_epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed"""
