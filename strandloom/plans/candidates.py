"""Candidate variants from read pileups, and the rules by which they are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import numeric as N

col = F.col


def pileup_observations(reads: DataFrame, reference_base: Callable[[Column], Column]) -> DataFrame:
    """Single-base mismatches of gapless reads: ``contig, sample, start_pos, ref, alt`` with counts.

    Bases are compared inside the row; only mismatches become rows, and counts combine before the shuffle.
    """
    n = F.length("seq")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (col("start_pos") + i).alias("pos"), F.substr("seq", i + 1, F.lit(1)).alias("alt"), reference_base(col("start_pos") + i).alias("ref")))
    x = reads.select("contig", "sample", "reverse", "mq", F.explode(F.filter(at, lambda v: v["alt"] != v["ref"])).alias("v"))
    return x.groupBy("contig", "sample", col("v.pos").alias("start_pos"), "v.ref", "v.alt").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(~col("reverse")).alias("n_forward"), F.sum("mq").alias("sum_mq"))


def cigar_candidates(reads: DataFrame, *, min_base_quality: int = 20) -> DataFrame:
    """Variants that reads show: ``contig, start_pos, end_pos, ref, alt, sample, quality, reverse``.

    ``reads`` carry ``ref_seq``, the reference of their whole region (soft clips included).  Matches are compared base by
    base; insertions and deletions come from the cigar.  N, P and clips only move along.
    """
    ops = C.walk(col("cigar"), col("start_pos"))
    ref_at = lambda pos, n: F.substr("ref_seq", (pos - col("start_pos") + 1).cast("int"), n)
    seq_at = lambda off, n: F.substr("seq", off + 1, n)

    def found(o: Column) -> Column:
        def cell(b: Column, e: Column, ref: Column, alt: Column, q: Column) -> Column:
            return F.struct(b.cast("bigint").alias("start_pos"), e.cast("bigint").alias("end_pos"), ref.alias("ref"), alt.alias("alt"), q.cast("int").alias("quality"))

        bases = F.transform(F.sequence(F.lit(0), o["size"] - 1), lambda i: cell(
            o["at"] + i, o["at"] + i + 1, ref_at(o["at"] + i, F.lit(1)), seq_at(o["off"] + i, F.lit(1)), F.get("quals", o["off"] + i)))
        snvs = F.filter(bases, lambda v: (v["ref"] != v["alt"]) & (v["ref"] != "N") & (v["alt"] != "N") & (v["quality"] >= min_base_quality))
        ins = F.array(cell(o["at"], o["at"], F.lit(""), seq_at(o["off"], o["size"]), F.array_min(F.slice("quals", o["off"] + 1, o["size"]))))
        dele = F.array(cell(o["at"], o["at"] + o["size"], ref_at(o["at"], o["size"]), F.lit(""), F.get("quals", F.greatest(o["off"] - 1, F.lit(0)))))
        return F.when(o["flag"].isin("M", "X", "="), snvs).when(o["flag"] == "I", ins).when(o["flag"] == "D", dele).otherwise(F.slice(snvs, 1, 0))

    cells = F.flatten(F.transform(ops, found))
    return reads.select("contig", "sample", "reverse", F.explode(cells).alias("v")).select("contig", "v.*", "sample", "reverse")


def observation_stats(candidates: DataFrame) -> DataFrame:
    """Per variant and sample: observations, forward support, quality sum."""
    return candidates.groupBy("contig", "start_pos", "end_pos", "ref", "alt", "sample").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(~col("reverse")).alias("n_forward"), F.sum("quality").alias("sum_quality"))


#: Least share of reads by the size of an inserted or deleted sequence (first row whose size fits), with the
#: least number of observations; long reads err by short indels.
LONG_READ_INSERTIONS = ((2, 0.2, 2), (3, 0.1, 2), (20, 0.05, 2), (200, 0.05, 1), (500, 0.02, 1), (None, None, 1))
LONG_READ_DELETIONS = ((2, 0.2, 2), (3, 0.1, 2), (50, 0.05, 2), (None, 0.1, 1))


def _by_size(size: Column, share: Column, table: tuple) -> Column:
    out = F.lit(False)
    for upto, least, observations in reversed(table):
        test = (col("n_obs") >= observations) & (share > least if least is not None else F.lit(True))
        out = test if upto is None else F.when(size <= upto, test).otherwise(out)
    return out


def include_long_reads(depth: Column) -> Column:
    """For reads with many small indel errors: the longer a gap, the less support it needs."""
    share = col("n_obs") / depth
    return F.when((F.length("ref") == 1) & (F.length("alt") == 1), (col("n_obs") > 1) & (share > 0.1)).when(
        F.length("alt") > F.length("ref"), _by_size(F.length("alt"), share, LONG_READ_INSERTIONS)).otherwise(
        _by_size(F.length("ref"), share, LONG_READ_DELETIONS))


def include_cell(depth: Column, *, pooled: bool = False) -> Column:
    """Single cells: a share of a fifth is likely, with more certainty asked of the pool than of one cell."""
    return (col("n_obs") > 1) & include_somatic(depth, min_frequency=0.2, min_probability=0.8 if pooled else 0.5)


def include_unknown_copy_number(depth: Column, normal: str | None, *, min_frequency: float = 0.01, min_probability: float = 0.75) -> Column:
    """Samples of unknown copy number by the somatic rule, the normal sample by the germline rule."""
    somatic = (col("n_obs") > 1) & include_somatic(depth, min_frequency=min_frequency, min_probability=min_probability)
    return somatic if normal is None else F.when(col("sample") == normal, include_germline(depth)).otherwise(somatic)


def any_sample_or_pool(observations: DataFrame, rule: Callable[[Column], Column], pooled: Callable[[Column], Column] | None = None) -> DataFrame:
    """Variants that ``rule`` accepts in a sample, or ``pooled`` in the sum of two samples or more; rows have ``depth``."""
    keys = ["contig", "start_pos", "end_pos", "ref", "alt"]
    x = observations.withColumn("_own", rule(col("depth")))
    x = x.groupBy(*keys).agg(F.bool_or("_own").alias("_any"), F.count(F.lit(1)).alias("_samples"), *[F.sum(c).alias(c) for c in ("n_obs", "n_forward", "sum_quality", "depth")])
    pool = F.lit(False) if pooled is None else (col("_samples") > 1) & pooled(col("depth"))
    return x.where(col("_any") | pool).select(*keys)


def match_key() -> Column:
    """Variants with the same key count as one candidate: exact for substitutions; insertions at one place by their base if they
    repeat one, else by their size and number of N; deletions by their begin."""
    homopolymer = F.length(F.replace("alt", F.substring("alt", 1, 1), F.lit(""))) == 0
    n = F.length("alt") - F.length(F.replace("alt", F.lit("N"), F.lit("")))
    ins = F.concat_ws("/", F.lit("I"), "start_pos", F.when(homopolymer, F.substring("alt", 1, 1)).otherwise(F.concat_ws(".", F.length("alt"), n)))
    dele = F.concat_ws("/", F.lit("D"), "start_pos")
    return F.when(F.length("alt") > F.length("ref"), ins).when(F.length("alt") < F.length("ref"), dele).otherwise(F.concat_ws("/", F.lit("S"), "start_pos", "ref", "alt"))


def include_simple(min_obs: int = 2) -> Column:
    return col("n_obs") >= min_obs


def include_germline(depth: Column, *, min_obs: int = 2, min_frequency: float = 0.1, min_mean_quality: float = 10.0) -> Column:
    """Enough observations of enough quality and share, not all on one strand once there are many."""
    one_strand = (col("n_obs") >= 10) & ((col("n_forward") == 0) | (col("n_forward") == col("n_obs")))
    return ((col("n_obs") >= min_obs) & (col("n_obs") >= depth * min_frequency) & (col("sum_quality") >= min_mean_quality * col("n_obs")) & ~one_strand)


def include_somatic(depth: Column, *, min_frequency: float = 0.01, min_probability: float = 0.75) -> Column:
    """Whether the allele's share exceeds ``min_frequency`` with at least ``min_probability`` (Beta posterior)."""
    below = N.beta_cdfs(F.array(F.array(col("n_obs") + 0.5, depth - col("n_obs") + 0.5, F.lit(min_frequency), F.lit(1.0))))
    return 1 - F.get(below, F.lit(0)) >= min_probability


#: Least share of reads by the size of an inserted or deleted sequence (first row whose size fits), with the
#: least number of observations; long reads err by short indels.
LONG_READ_INSERTIONS = ((2, 0.2, 2), (3, 0.1, 2), (20, 0.05, 2), (200, 0.05, 1), (500, 0.02, 1), (None, None, 1))
LONG_READ_DELETIONS = ((2, 0.2, 2), (3, 0.1, 2), (50, 0.05, 2), (None, 0.1, 1))


def _by_size(size: Column, share: Column, table: tuple) -> Column:
    out = F.lit(False)
    for upto, least, observations in reversed(table):
        test = (col("n_obs") >= observations) & (share > least if least is not None else F.lit(True))
        out = test if upto is None else F.when(size <= upto, test).otherwise(out)
    return out


def include_long_reads(depth: Column) -> Column:
    """For reads with many small indel errors: the longer a gap, the less support it needs."""
    share = col("n_obs") / depth
    return F.when((F.length("ref") == 1) & (F.length("alt") == 1), (col("n_obs") > 1) & (share > 0.1)).when(
        F.length("alt") > F.length("ref"), _by_size(F.length("alt"), share, LONG_READ_INSERTIONS)).otherwise(
        _by_size(F.length("ref"), share, LONG_READ_DELETIONS))


def include_cell(depth: Column, *, pooled: bool = False) -> Column:
    """Single cells: a share of a fifth is likely, with more certainty asked of the pool than of one cell."""
    return (col("n_obs") > 1) & include_somatic(depth, min_frequency=0.2, min_probability=0.8 if pooled else 0.5)


def include_unknown_copy_number(depth: Column, normal: str | None, *, min_frequency: float = 0.01, min_probability: float = 0.75) -> Column:
    """Samples of unknown copy number by the somatic rule, the normal sample by the germline rule."""
    somatic = (col("n_obs") > 1) & include_somatic(depth, min_frequency=min_frequency, min_probability=min_probability)
    return somatic if normal is None else F.when(col("sample") == normal, include_germline(depth)).otherwise(somatic)


def any_sample_or_pool(observations: DataFrame, rule: Callable[[Column], Column], pooled: Callable[[Column], Column] | None = None) -> DataFrame:
    """Variants that ``rule`` accepts in a sample, or ``pooled`` in the sum of two samples or more; rows have ``depth``."""
    keys = ["contig", "start_pos", "end_pos", "ref", "alt"]
    x = observations.withColumn("_own", rule(col("depth")))
    x = x.groupBy(*keys).agg(F.bool_or("_own").alias("_any"), F.count(F.lit(1)).alias("_samples"), *[F.sum(c).alias(c) for c in ("n_obs", "n_forward", "sum_quality", "depth")])
    pool = F.lit(False) if pooled is None else (col("_samples") > 1) & pooled(col("depth"))
    return x.where(col("_any") | pool).select(*keys)


def match_key() -> Column:
    """Variants with the same key count as one candidate: exact for substitutions; insertions at one place by their base if they
    repeat one, else by their size and number of N; deletions by their begin."""
    homopolymer = F.length(F.replace("alt", F.substring("alt", 1, 1), F.lit(""))) == 0
    n = F.length("alt") - F.length(F.replace("alt", F.lit("N"), F.lit("")))
    ins = F.concat_ws("/", F.lit("I"), "start_pos", F.when(homopolymer, F.substring("alt", 1, 1)).otherwise(F.concat_ws(".", F.length("alt"), n)))
    dele = F.concat_ws("/", F.lit("D"), "start_pos")
    return F.when(F.length("alt") > F.length("ref"), ins).when(F.length("alt") < F.length("ref"), dele).otherwise(F.concat_ws("/", F.lit("S"), "start_pos", "ref", "alt"))


def include_simple(min_obs: int = 2) -> Column:
    return col("n_obs") >= min_obs


def include_germline(depth: Column, *, min_obs: int = 2, min_frequency: float = 0.1, min_mean_quality: float = 10.0) -> Column:
    """Enough observations of enough quality and share, not all on one strand once there are many."""
    one_strand = (col("n_obs") >= 10) & ((col("n_forward") == 0) | (col("n_forward") == col("n_obs")))
    return ((col("n_obs") >= min_obs) & (col("n_obs") >= depth * min_frequency) & (col("sum_quality") >= min_mean_quality * col("n_obs")) & ~one_strand)


def include_somatic(depth: Column, *, min_frequency: float = 0.01, min_probability: float = 0.75) -> Column:
    """Whether the allele's share exceeds ``min_frequency`` with at least ``min_probability`` (Beta posterior)."""
    below = F.get(N.beta_cdfs(F.array(F.array(col("n_obs") + 0.5, depth - col("n_obs") + 0.5, F.lit(min_frequency), F.lit(1.0)))), F.lit(0))
    return F.when(col("n_obs").isNotNull() & depth.isNotNull(), 1 - below >= min_probability)
