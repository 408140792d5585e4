"""Genotype models as relational plans over a likelihood table.

``likelihoods(block_id, sample, read_id, haplotype_id, ln_p)`` holds the log-likelihood of each read under each haplotype.
Genotypes are sorted multisets of haplotype numbers.  All sums of exponentials are taken per group after subtracting the
group's largest exponent, with built-in aggregates that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N

col = F.col


def genotypes(haplotypes: DataFrame, ploidy: int, keys: list[str] = ("block_id",), *, limit: int | None = None) -> DataFrame:
    """All sorted multisets of ``ploidy`` of each block's haplotypes: ``haplotype_ids``.  C(n + k - 1, k) per block.

    ``limit`` (the caller's bound on haplotypes per block) raises if a block exceeds it, before the self-joins run.
    """
    keys = list(keys)
    h = haplotypes.select(*keys, "haplotype_id").distinct()
    if limit is not None:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        h = h.withColumn("_n", n).where(F.when(col("_n") > limit, F.raise_error(F.lit("too many haplotypes in a block")).cast("boolean")).otherwise(True)).drop("_n")
    out = h.select(*keys, F.array("haplotype_id").alias("haplotype_ids"))
    for _ in range(ploidy - 1):
        nxt = h.withColumnRenamed("haplotype_id", "_next")
        out = out.join(nxt, keys).where(col("_next") >= F.element_at("haplotype_ids", -1)).select(
            *keys, F.concat("haplotype_ids", F.array("_next")).alias("haplotype_ids"))
    return out


def genotype_count(n: int, k: int) -> int:
    return math.comb(n + k - 1, k)


def genotype_likelihoods(gts: DataFrame, likelihoods: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """ln P(reads | genotype) per sample: the sum over reads of ln of the mean of its haplotypes' likelihoods.

    Reads are gathered once, not once a genotype, and those of equal likelihoods are counted before they meet the genotypes.
    """
    keys = list(keys)
    per_read = likelihoods.groupBy(*keys, "sample", "read_id").agg(F.sort_array(F.collect_list(F.struct("haplotype_id", "ln_p"))).alias("_p"))  # as many as the block has haplotypes
    kinds = per_read.groupBy(*keys, "sample", "_p").agg(F.count(F.lit(1)).alias("_n"))
    lns = F.flatten(F.transform("haplotype_ids", lambda h: F.transform(F.filter("_p", lambda x: x["haplotype_id"] == h), lambda x: x["ln_p"])))
    x = gts.select(*keys, "haplotype_ids").join(kinds, keys).withColumn("_lns", lns).where(F.size("_lns") > 0)
    m = F.array_max("_lns")
    ln = m + F.log(F.aggregate("_lns", F.lit(0.0), lambda a, v: a + F.exp(v - m))) - F.log(F.size("haplotype_ids").cast("double"))
    return x.withColumn("_ln", ln * col("_n")).groupBy(*keys, "sample", "haplotype_ids").agg(F.sum("_ln").alias("ln_likelihood"))


def mixture_likelihoods(gts: DataFrame, likelihoods: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """As above with a weight per haplotype of the genotype (``weights`` array beside ``haplotype_ids``)."""
    keys = list(keys)
    members = gts.select(*keys, "haplotype_ids", F.explode(F.arrays_zip("haplotype_ids", "weights")).alias("z")).select(
        *keys, "haplotype_ids", col("z.haplotype_ids").alias("haplotype_id"), F.log("z.weights").alias("ln_w"))
    x = members.join(likelihoods, [*keys, "haplotype_id"]).withColumn("v", col("ln_p") + col("ln_w"))
    per_read = x.groupBy(*keys, "sample", "haplotype_ids", "read_id").agg(N.log_sum_exp(F.collect_list("v")).alias("ln"))
    return per_read.groupBy(*keys, "sample", "haplotype_ids").agg(F.sum("ln").alias("ln_likelihood"))


def hardy_weinberg_ln_prior(haplotype_ids: Column, frequencies: Column) -> Column:
    """ln prior of a genotype: the multinomial coefficient times the product of frequencies (map of haplotype -> frequency)."""
    distinct = F.array_distinct(haplotype_ids)
    counts = F.transform(distinct, lambda h: F.size(F.filter(haplotype_ids, lambda g: g == h)).cast("double"))
    ln_f = F.aggregate(haplotype_ids, F.lit(0.0), lambda a, h: a + F.log(F.element_at(frequencies, h)))
    return N.log_multinomial(counts) + ln_f


def normalise(df: DataFrame, ln: str, keys: list[str], out: str = "posterior") -> DataFrame:
    """exp(ln) over its sum within ``keys``.  Groups are the genotypes of a sample and block, which the model bounds."""
    w = W.partitionBy(*keys)
    x = df.withColumn("_m", F.max(ln).over(w)).withColumn("_e", F.exp(col(ln) - col("_m")))
    return x.withColumn(out, col("_e") / F.sum("_e").over(w)).drop("_m", "_e")


def individual_posteriors(likelihoods: DataFrame, priors: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """Posterior of each genotype per sample: likelihood times prior, normalised."""
    keys = list(keys)
    x = likelihoods.join(priors, [*keys, "haplotype_ids"]).withColumn("ln_joint", col("ln_likelihood") + col("ln_prior"))
    return normalise(x, "ln_joint", [*keys, "sample"])


def evidence(likelihoods: DataFrame, priors: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """ln of the sum of the joint probabilities."""
    keys = list(keys)
    x = likelihoods.join(priors, [*keys, "haplotype_ids"]).withColumn("v", col("ln_likelihood") + col("ln_prior"))
    x = x.withColumn("m", F.max("v").over(W.partitionBy(*keys, "sample")))
    return x.groupBy(*keys, "sample").agg((F.max("m") + F.log(F.sum(F.exp(col("v") - col("m"))))).alias("ln_evidence"))


def allele_posteriors(posteriors: DataFrame, carriers: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """P(allele) per sample: the mass of genotypes with a haplotype that carries it; ``homozygous`` if all do.

    ``carriers(block_id, haplotype_id, allele_id)``.
    """
    keys = list(keys)
    members = posteriors.select(*keys, "sample", "haplotype_ids", "posterior", F.explode("haplotype_ids").alias("haplotype_id"))
    hits = members.join(carriers, [*keys, "haplotype_id"]).groupBy(*keys, "sample", "haplotype_ids", "allele_id").agg(
        F.first("posterior").alias("posterior"), F.count(F.lit(1)).alias("n"))
    return hits.groupBy(*keys, "sample", "allele_id").agg(
        F.sum("posterior").alias("posterior"), F.sum(F.when(col("n") == F.size("haplotype_ids"), col("posterior")).otherwise(0.0)).alias("homozygous"))


def best_genotypes(posteriors: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """The genotype of largest posterior per sample with its phred quality; ties by the haplotype numbers."""
    keys = list(keys)
    best = F.max_by(F.struct("haplotype_ids", "posterior"), F.struct("posterior", F.transform("haplotype_ids", lambda h: -h)))
    x = posteriors.groupBy(*keys, "sample").agg(best.alias("b"))
    return x.select(*keys, "sample", "b.haplotype_ids", "b.posterior", N.probability_true_to_phred(col("b.posterior")).alias("gq"))


def population_em(likelihoods: DataFrame, haplotypes: DataFrame, keys: list[str] = ("block_id",), *, rounds: int = 20, ploidy: int = 2) -> DataFrame:
    """EM of haplotype frequencies under Hardy-Weinberg, jointly over samples.

    E: posteriors under the current frequencies; M: expected haplotype shares.  Each block is small and independent, so
    the iterations run inside a grouped function: one shuffle by block for all rounds.
    """
    keys = list(keys)
    import numpy as np
    import pandas as pd

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gts = [tuple(g) for g in pdf["haplotype_ids"].map(tuple).unique()]
        ids = sorted({h for g in gts for h in g})
        counts = np.array([[g.count(h) for h in ids] for g in gts], float)
        from math import lgamma

        coef = np.array([lgamma(sum(c) + 1) - sum(lgamma(x + 1) for x in c) for c in counts])
        table = pdf.assign(g=pdf["haplotype_ids"].map(tuple)).pivot(index="sample", columns="g", values="ln_likelihood")[gts]
        lik = table.to_numpy()
        freq = np.full(len(ids), 1 / len(ids))
        for _ in range(rounds):
            ln = lik + coef + counts @ np.log(np.maximum(freq, 1e-300))
            post = np.exp(ln - ln.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            freq = (post @ counts).sum(axis=0) / (len(lik) * counts.sum(axis=1).max())
        rows = [(*group, s, list(map(int, g)), float(post[i, j])) for i, s in enumerate(table.index) for j, g in enumerate(gts)]
        return pd.DataFrame(rows, columns=[*keys, "sample", "haplotype_ids", "posterior"])

    schema = ", ".join(f"{k} {likelihoods.schema[k].dataType.simpleString()}" for k in keys) + ", sample string, haplotype_ids array<int>, posterior double"
    gts = genotypes(haplotypes, ploidy, keys)
    return genotype_likelihoods(gts, likelihoods, keys).groupBy(*keys).applyInPandas(run, schema)


def trio_posteriors(likelihoods: DataFrame, mother: str, father: str, child: str, keys: list[str] = ("block_id",), *, top: int = 100,
                    ln_denovo: float = math.log(1e-8), transition: DataFrame | None = None) -> DataFrame:
    """Joint posteriors of mother, father and child genotypes (diploid, uniform parental prior).

    Each parent's list is cut to its ``top`` genotypes before they meet, the model's bound on combinations; the child
    gets half its haplotypes from each parent.  With ``transition`` (see :mod:`strandloom.plans.mutation`) a parent passes
    haplotypes on with the probability of the mutations between them; without it any other haplotype costs one de novo event.
    """
    keys = list(keys)
    rank = F.row_number().over(W.partitionBy(*keys, "sample").orderBy(F.desc(F.round("ln_likelihood", 9)), "haplotype_ids"))
    best = likelihoods.withColumn("_k", rank).where(col("_k") <= top).drop("_k")
    part = lambda s, p: best.where(col("sample") == s).select(*keys, col("haplotype_ids").alias(p), col("ln_likelihood").alias(f"ln_{p}"))
    x = part(mother, "m").join(part(father, "f"), keys).join(part(child, "c"), keys)
    pass_on = lambda p, h: F.size(F.filter(p, lambda g: g == h)) / 2.0
    way = lambda a, b: pass_on(col("m"), a) * pass_on(col("f"), b)
    c0, c1 = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    inherited = F.when(c0 == c1, way(c0, c1)).otherwise(way(c0, c1) + way(c1, c0))
    if transition is not None:
        from .mutation import passed_on

        x = x.join(transition, keys)
        go = lambda a, b: passed_on(col("m"), a, col("transition")) * passed_on(col("f"), b, col("transition"))
        child = F.when(c0 == c1, go(c0, c1)).otherwise(go(c0, c1) + go(c1, c0))
        ln = col("ln_m") + col("ln_f") + col("ln_c") + F.log(F.greatest(child, F.lit(1e-300)))
        return normalise(x.withColumn("is_denovo", inherited == 0).withColumn("ln_joint", ln).drop("transition"), "ln_joint", keys)
    some = F.when(F.arrays_overlap("c", "m") | F.arrays_overlap("c", "f"), ln_denovo).otherwise(2 * ln_denovo)
    ln = col("ln_m") + col("ln_f") + col("ln_c") + F.when(inherited > 0, F.log(inherited)).otherwise(some)
    return normalise(x.withColumn("is_denovo", inherited == 0).withColumn("ln_joint", ln), "ln_joint", keys)


def coalescent_ln(k: int, n: int, theta: float) -> float:
    """ln probability of ``k`` segregating sites among ``n`` sequences under the coalescent with mutation rate ``theta``.

    The alternating sum cancels, so it is taken in exact fractions.
    """
    from fractions import Fraction

    t = Fraction(theta).limit_denominator(10 ** 12)
    total = sum((-1) ** i * math.comb(n - 1, i - 1) * Fraction(i - 1, 1) / (t + i - 1) * (t / (t + i - 1)) ** k for i in range(2, n + 1))
    return math.log(total) if total > 0 else float("-inf")


def mixture_em(ln: list[list[float]], rounds: int = 100, concentration: float = 1.0) -> list[float]:
    """Weights of mixture components from a reads-by-haplotypes table of log-likelihoods (variational Bayes with a Dirichlet prior)."""
    import numpy as np

    x = np.asarray(ln, float)
    alpha = np.full(x.shape[1], concentration)
    digamma = np.vectorize(_digamma)
    for _ in range(rounds):
        r = x + digamma(alpha) - _digamma(alpha.sum())
        r = np.exp(r - r.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        new = concentration + r.sum(axis=0)
        if np.abs(new - alpha).max() < 1e-9:
            break
        alpha = new
    return list(alpha / alpha.sum())


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def clone_mixtures(likelihoods: DataFrame, keys: list[str] = ("block_id",), *, concentration: float = 1.0) -> DataFrame:
    """Haplotype weights of each sample's mixture (polyclonal, tumour or bulk samples): ``haplotype_id, weight``."""
    keys = list(keys)
    import pandas as pd

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="read_id", columns="haplotype_id", values="ln_p", aggfunc="max").fillna(-1e3)
        w = mixture_em(table.to_numpy().tolist(), concentration=concentration)
        return pd.DataFrame([(*group, int(h), float(x)) for h, x in zip(table.columns, w)], columns=[*keys, "sample", "haplotype_id", "weight"])

    schema = ", ".join(f"{k} {likelihoods.schema[k].dataType.simpleString()}" for k in keys) + ", sample string, haplotype_id int, weight double"
    return likelihoods.groupBy(*keys, "sample").applyInPandas(run, schema)


def rank_haplotypes(likelihoods: DataFrame, keys: list[str] = ("block_id", "sample")) -> DataFrame:
    """Haplotypes by total likelihood (to 9 decimals), best first; ties by their number."""
    x = likelihoods.groupBy(*keys, "haplotype_id").agg(F.sum("ln_p").alias("ln_total"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("ln_total", 9)), "haplotype_id")))


def template_likelihoods(likelihoods: DataFrame, template: Column, keys: list[str] = ("block_id", "sample")) -> DataFrame:
    """Likelihood of linked reads under a haplotype: the sum over the reads of a template."""
    return likelihoods.groupBy(*keys, template.alias("template"), "haplotype_id").agg(F.sum("ln_p").alias("ln_p"), F.count(F.lit(1)).alias("n_reads"))


def model_posterior(evidence: DataFrame, dummy: DataFrame, keys: list[str] = ("block_id", "sample")) -> DataFrame:
    """Probability of a model against a dummy one of equal prior, from both ``ln_evidence``: ``posterior`` and its phred ``mp``
    (infinite where the odds are beyond a double)."""
    keys = list(keys)
    x = evidence.join(dummy.select(*keys, col("ln_evidence").alias("_dummy")), keys)
    p = 1 / (1 + F.exp(col("_dummy") - col("ln_evidence")))
    # not by way of the small probability of the dummy, which would end at the least positive double
    return x.select(*keys, p.alias("posterior"), (10 * F.log10(1 + F.exp(col("ln_evidence") - col("_dummy")))).alias("mp"))


def collapse_duplicates(haplotypes: DataFrame, keys: list[str] = ("block_id",), *, sequence: str = "hap_seq", prior: str = "ln_prior") -> DataFrame:
    """Of haplotypes with one sequence the most probable; ties by their number."""
    w = W.partitionBy(*keys, sequence).orderBy(F.desc(prior), "haplotype_id")
    return haplotypes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def remove_unlikely(posteriors: DataFrame, least: float, keys: list[str] = ("block_id",), protected: Column | None = None) -> DataFrame:
    """Haplotypes whose posterior, the mass of genotypes that hold them, reaches ``least`` in a sample; protected ones stay."""
    keys = list(keys)
    mass = posteriors.select(*keys, "sample", "posterior", F.explode(F.array_distinct("haplotype_ids")).alias("haplotype_id")).groupBy(*keys, "sample", "haplotype_id").agg(F.sum("posterior").alias("p"))
    x = mass.groupBy(*keys, "haplotype_id").agg(F.max("p").alias("posterior"))
    keep = col("posterior") >= least
    return x.where(keep if protected is None else keep | protected)


def coalescent_table(spark, max_sites: int, sizes: list[int], theta: float) -> DataFrame:
    """``k, n, ln_p`` of :func:`coalescent_ln` for up to ``max_sites`` sites: a bounded table to join with."""
    rows = [(k, n, coalescent_ln(k, n, theta)) for n in sizes for k in range(max_sites + 1)]
    return spark.createDataFrame(rows, "k int, n int, ln_p double")
