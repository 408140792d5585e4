"""Read assignment, phase blocks, pairwise phasing and call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import regions as R

col = F.col


def assign_reads(likelihoods: DataFrame, keys: list[str] = ("block_id", "sample"), *, eps: float = 1e-9) -> DataFrame:
    """The haplotype(s) of largest likelihood of each read: ``haplotype_ids`` (all ties) and ``is_ambiguous``."""
    best = F.max("ln_p")
    all_ = F.collect_list(F.struct("haplotype_id", "ln_p"))  # as many as the block has haplotypes
    x = likelihoods.groupBy(*keys, "read_id").agg(best.alias("_m"), all_.alias("_all"))
    ties = F.array_sort(F.transform(F.filter("_all", lambda h: F.abs(h["ln_p"] - col("_m")) < eps), lambda h: h["haplotype_id"]))
    return x.withColumn("haplotype_ids", ties).withColumn("is_ambiguous", F.size("haplotype_ids") > 1).withColumnRenamed("_m", "ln_likelihood").drop("_all")


def allele_support(assigned: DataFrame, carriers: DataFrame, keys: list[str] = ("block_id",)) -> DataFrame:
    """Reads and the alleles they support: an allele counts if all tied haplotypes carry it (``block_id, haplotype_id, allele_id``)."""
    keys = list(keys)
    x = assigned.select(*keys, "sample", "read_id", F.size("haplotype_ids").alias("_n"), F.explode("haplotype_ids").alias("haplotype_id"))
    hits = x.join(carriers, [*keys, "haplotype_id"]).groupBy(*keys, "sample", "read_id", "allele_id").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n"))
    return hits.where("_k = _n").drop("_k", "_n")


def phase_blocks(calls: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Add ``block``: a call joins its predecessor's block if their phase regions or the calls themselves overlap.

    The comparison with the predecessor and the running count are window functions over the calls of a contig, which
    are thousands of times fewer than reads.
    """
    w = W.partitionBy(*keys).orderBy("start_pos", "call_id")
    me = F.struct("start_pos", "end_pos", "phase_begin", "phase_end")
    x = calls.withColumn("_p", F.lag(me).over(w))
    joined = (R.overlap_size(R.Region(col("phase_begin"), col("phase_end")), R.Region(col("_p.phase_begin"), col("_p.phase_end"))) > 0) | (
        R.overlaps(R.Region(col("start_pos"), col("end_pos")), R.Region(col("_p.start_pos"), col("_p.end_pos"))))
    x = x.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return x.withColumn("block", F.sum("_new").over(w)).drop("_p", "_new")


def pair_phase_quality(posteriors: DataFrame, keys: list[str] = ("block_id", "sample")) -> DataFrame:
    """Phase quality of each pair of neighbouring heterozygous sites from joint posteriors.

    ``posteriors(block_id, sample, site_a, site_b, in_cis, posterior)``: the mass of genotypes with both alternative alleles on
    one haplotype, or on different ones.
    """
    x = posteriors.groupBy(*keys, "site_a", "site_b").agg(F.sum(F.when(col("in_cis"), col("posterior")).otherwise(0.0)).alias("cis"), F.sum("posterior").alias("all"))
    best = F.greatest(col("cis"), col("all") - col("cis")) / col("all")
    return x.select(*keys, "site_a", "site_b", (col("cis") * 2 >= col("all")).alias("in_cis"), N.probability_true_to_phred(best).alias("quality"))


def phase_sets(pairs: DataFrame, keys: list[str] = ("block_id", "sample"), *, min_score: float = 5.0) -> DataFrame:
    """Runs of sites whose neighbouring pairs all reach ``min_score``; a set's quality is its least pair quality."""
    w = W.partitionBy(*keys).orderBy("site_a")
    x = pairs.withColumn("_new", F.when(col("quality") >= min_score, 0).otherwise(1))
    x = x.withColumn("_set", F.sum("_new").over(w))
    good = x.where("_new = 0").groupBy(*keys, "_set").agg(F.min("site_a").alias("first_site"), F.max("site_b").alias("last_site"), F.min("quality").alias("quality"))
    return good.drop("_set")


def phase_cliques(pairs: DataFrame, keys: list[str] = ("block_id", "sample"), *, min_score: float = 5.0) -> DataFrame:
    """Sets of sites all of whose pairs reach ``min_score``: ``sites`` (ascending) and ``quality``, the least of their pairs.

    Sites are taken in order; a site joins the set that is open if it agrees with all its members, else it opens the next.
    ``pairs`` holds every pair of a block's heterozygous sites, which a block bounds.
    """
    keys = list(keys)
    import pandas as pd

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        score = {(a, b): q for a, b, q in zip(pdf["site_a"], pdf["site_b"], pdf["quality"])}
        sites = sorted({*pdf["site_a"], *pdf["site_b"]})
        open_, least, rows = [sites[0]], float("inf"), []
        for s in sites[1:]:
            worst = min(score.get((m, s), float("-inf")) for m in open_)
            if worst >= min_score:
                open_, least = [*open_, s], min(least, worst)
            else:
                rows.append((*group, open_, least))
                open_, least = [s], float("inf")
        rows.append((*group, open_, least))
        return pd.DataFrame([(*r[:-2], [int(x) for x in r[-2]], None if r[-1] == float("inf") else r[-1]) for r in rows], columns=[*keys, "sites", "quality"])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", sites array<bigint>, quality double"
    return pairs.groupBy(*keys).applyInPandas(run, schema)


def assign(likelihoods: DataFrame, action: str = "drop", keys: list[str] = ("block_id", "sample"), *, seed: int = 1, eps: float = 1e-9) -> DataFrame:
    """One row per read and haplotype it goes to.  Reads with several best haplotypes are dropped, or go to the ``first``, to one
    chosen by a seeded hash (``random``), or to ``all``."""
    return assign_by(likelihoods, [action], keys, seed=seed, eps=eps).drop("action")


def assign_by(likelihoods: DataFrame, actions: list[str], keys: list[str] = ("block_id", "sample"), *, seed: int = 1, eps: float = 1e-9) -> DataFrame:
    """:func:`assign` by each of several actions (column ``action``), from reads that are gathered once."""
    x = assign_reads(likelihoods, keys, eps=eps)
    ids = col("haplotype_ids")
    chosen = {"drop": F.when(~col("is_ambiguous"), ids), "first": F.slice(ids, 1, 1), "all": ids,
              "random": F.array(F.get(ids, F.pmod(F.xxhash64(F.lit(seed), "read_id"), F.size(ids)).cast("int")))}
    each = x.select(*keys, "read_id", "is_ambiguous", "ln_likelihood", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), chosen[a].alias("ids")) for a in actions])).alias("_c"))
    return each.select(*keys, "read_id", "is_ambiguous", "ln_likelihood", "_c.action", F.explode("_c.ids").alias("haplotype_id"))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """Text lines of single-sample records; positions are one-based."""
    called = F.filter("gt", lambda g: g > 0)
    info = F.concat(F.lit("AC="), F.size(called).cast("string"), F.lit(";AN="), F.size("gt").cast("string"))
    gt = F.concat(F.array_join(F.transform("gt", lambda g: g.cast("string")), "|"), F.lit(":"), col("gq").cast("string"))
    return calls.select(F.concat_ws("\t", "contig", (col("start_pos") + 1).cast("string"), col("call_id").cast("string"), "ref", F.array_join("alts", ","),
                                    col("qual").cast("string"), F.lit("PASS"), info, F.lit("GT:GQ"), gt).alias("line"))


