"""How likely one haplotype turns into another: de novo, somatic and indel mutation, and the priors built on them."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.interval import interval_join

col = F.col
#: Factors on the base rate of gaps by the number of periods of the repeat they are in (the last entry goes on), by period.
REPEAT_FACTORS: Mapping[int, tuple[float, ...]] = {
    1: (1, 1, 1, 2, 4, 8, 16, 32, 64, 128), 2: (1, 1, 2, 4, 8, 16, 32, 64), 3: (1, 1, 2, 4, 8, 16, 32)}


def indel_factor(period: Column, n_periods: Column, table: Mapping[int, tuple[float, ...]] = REPEAT_FACTORS) -> Column:
    """How much likelier a gap is in a repeat than elsewhere; 1 outside of repeats and for periods not in the table."""
    out = F.lit(1.0)
    for p, row in table.items():
        values = F.array(*[F.lit(float(v)) for v in row])
        out = F.when(period == p, F.element_at(values, F.least(F.greatest(n_periods, F.lit(1)), F.lit(len(row))).cast("int"))).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def allele_costs(blocks: DataFrame, repeats: DataFrame | None = None, *, snv_rate: float, indel_rate: float, extension: float = 0.5,
                 table: Mapping[int, tuple[float, ...]] = REPEAT_FACTORS) -> DataFrame:
    """``block_id, allele_id, ln_p`` of each variant of a block arising once.

    A substitution costs its rate for each base; a gap costs its rate, higher in tandem repeats, and ``extension`` for each further base.
    """
    v = blocks.select("block_id", "contig", F.posexplode("variants").alias("allele_id", "v")).select("block_id", "contig", "allele_id", "v.start_pos", "v.end_pos", "v.ref", "v.alt")
    factor = F.lit(1.0)
    if repeats is not None:
        hits = interval_join(v, repeats).groupBy(col("l.block_id").alias("block_id"), col("l.allele_id").alias("allele_id")).agg(F.max(indel_factor(
            col("r.period"), F.floor((col("r.end_pos") - col("r.start_pos")) / col("r.period")), table)).alias("_f"))
        v = v.join(hits, ["block_id", "allele_id"], "left")
        factor = F.coalesce("_f", F.lit(1.0))
    gap = F.abs(F.length("ref") - F.length("alt"))
    ln = F.when(gap > 0, F.log(F.least(F.lit(indel_rate) * factor, F.lit(0.5))) + (gap - 1) * math.log(extension)).otherwise(
        F.greatest(F.length("ref"), F.lit(1)) * math.log(snv_rate))
    return v.select("block_id", "allele_id", ln.alias("ln_p"))


def transitions(haplotypes: DataFrame, costs: DataFrame) -> DataFrame:
    """``block_id, target, given, ln_p`` for all pairs of a block's haplotypes (the model bounds their number): the alleles in which
    they differ arise, or go, one by one; a haplotype turns into itself with probability 1."""
    cost = costs.groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct("allele_id", "ln_p"))).alias("_cost"))
    h = haplotypes.select("block_id", "haplotype_id", "allele_ids")
    x = h.withColumnRenamed("haplotype_id", "target").withColumnRenamed("allele_ids", "_t").join(
        h.withColumnRenamed("haplotype_id", "given").withColumnRenamed("allele_ids", "_g"), "block_id").join(cost, "block_id", "left")
    differ = F.concat(F.array_except("_t", "_g"), F.array_except("_g", "_t"))
    ln = F.aggregate(differ, F.lit(0.0), lambda s, a: s + F.coalesce(F.try_element_at("_cost", a), F.lit(0.0)))
    return x.select("block_id", "target", "given", ln.alias("ln_p"))


def transition_map(table: DataFrame) -> DataFrame:
    """One row per block with the probabilities by ``target>given``; pairs without a row are impossible."""
    key = F.concat_ws(">", col("target").cast("string"), col("given").cast("string"))
    return table.groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.exp("ln_p").alias("p")))).alias("transition"))


def passed_on(parent: Column, haplotype: Column, transition: Column) -> Column:
    """Probability that a parent's genotype passes on a haplotype: the mean over its haplotypes."""
    ways = F.transform(parent, lambda g: F.coalesce(F.try_element_at(transition, F.concat_ws(">", haplotype.cast("string"), g.cast("string"))), F.lit(0.0)))
    return F.aggregate(ways, F.lit(0.0), lambda s, p: s + p) / F.size(parent)


def cancer_genotype_ln_prior(germline_ln_prior: Column, germline: Column, somatic: Column, transition: Column) -> Column:
    """Prior of germline haplotypes with somatic ones: each somatic haplotype comes from the germline one that makes it likeliest."""
    best = F.transform(somatic, lambda s: F.array_max(F.transform(germline, lambda g: F.coalesce(F.try_element_at(transition, F.concat_ws(">", s.cast("string"), g.cast("string"))), F.lit(0.0)))))
    return germline_ln_prior + F.aggregate(best, F.lit(0.0), lambda acc, p: acc + F.log(F.greatest(p, F.lit(1e-300))))
