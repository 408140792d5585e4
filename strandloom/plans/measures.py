"""Named call measures: a registry of aggregate expressions over shared facets.

Facets are the inputs that measures share; only those that the requested measures need are built, and all measures
of a facet and level are computed in one aggregation.

* ``call``: columns of the call row.  Level *call*.
* ``genotype``: one row per call and sample with the genotype ``gt`` (allele numbers, 0 the reference).  Level *sample*.
* ``reads``: overlapping reads of a call and sample.  Levels *call* (samples pooled) and *sample*.
* ``depth``, ``raw_depth``: runs of equal depth of a sample that a call overlaps, from a sweep over the reads.  Level *sample*.
* ``support``: reads assigned to alleles that the sample is called with, one row per read and allele.  Levels *sample* and *allele*.
* ``duplicates``: those reads by group of duplicates.  Level *allele*.

Tables: ``calls(call_id, contig, start_pos, end_pos, ref, alts, qual, ...)``, ``genotypes(call_id, sample, gt, gq, mp, ploidy, ...)``,
``reads`` (see :mod:`strandloom.operators.reads`; ``raw_reads`` for unfiltered depth) and
``support(call_id, sample, allele, <read columns>)``: reads and the alleles they are assigned to (see :mod:`strandloom.plans.facets`).
An allele that a sample is not called with has no value; a called one without reads has a depth of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import cigar as C
from ..functions import numeric as N
from ..functions import regions as R
from ..functions import sequences as S
from ..operators.coverage import depth_runs
from ..operators.interval import interval_join, sum_overlapped

col = F.col


@dataclass(frozen=True)
class Measure:
    name: str
    title: str
    level: str                      # call, sample or allele
    facets: tuple[str, ...]
    value: Callable[[], Column]     # over the prepared columns of its level
    aggregator: str | None = None   # over alleles: sum, min, max, min_tail, max_tail
    inputs: tuple[str, ...] = ()    # prepared aggregates it needs


@dataclass(frozen=True)
class Prepared:
    """An aggregate that measures of one facet and level are made of."""

    facet: str
    level: str
    value: Callable[[], Column]


PREPARED: dict[str, Prepared] = {}
MEASURES: dict[str, Measure] = {}


def prepared(name: str, facet: str, level: str, value: Callable[[], Column]) -> None:
    PREPARED[name] = Prepared(facet, level, value)


def measure(name: str, title: str, level: str, value: Callable[[], Column], *, inputs: Iterable[str] = (), aggregator: str | None = None) -> None:
    facets = tuple(sorted({PREPARED[i].facet for i in inputs} | ({"genotype"} if level != "call" else set()) | {"call"}))
    MEASURES[name] = Measure(name, title, level, facets, value, aggregator, tuple(inputs))


def _clip_share() -> Column:
    return F.aggregate(F.filter("cigar", lambda o: o["flag"].isin("S", "H")), F.lit(0), lambda a, o: a + o["size"]) / F.length("seq")


# prepared aggregates over overlapping reads
prepared("max_read_length", "reads", "sample", lambda: F.max("r.length"))
#: Sums over overlapping reads (columns of a read), taken from running sums without pairs of calls and reads.
SUMS: dict[str, Callable[[], Column]] = {}


def summed(name: str, level: str, value: Callable[[], Column]) -> None:
    SUMS[name] = value
    prepared(name, "reads", level, value)


summed("n_overlapping", "sample", lambda: F.lit(1))
summed("all_forward", "sample", lambda: ~col("reverse"))
summed("all_reverse", "sample", lambda: col("reverse"))
summed("n_all", "call", lambda: F.lit(1))
summed("n_clipped", "call", lambda: C.is_soft_clipped(col("cigar")) & (_clip_share() > 0.25))
summed("n_mq_zero", "call", lambda: col("mq") == 0)
summed("sum_mq_squares", "call", lambda: col("mq").cast("long") * col("mq"))
prepared("max_depth", "depth", "sample", lambda: F.max("r.depth"))
prepared("max_raw_depth", "raw_depth", "sample", lambda: F.max("r.depth"))
# over reads that support a called allele
prepared("n_support", "support", "allele", lambda: F.count(F.lit(1)))
prepared("median_mq", "support", "allele", lambda: F.median("mq"))
prepared("n_forward", "support", "allele", lambda: F.count_if(~col("reverse")))
prepared("n_reverse", "support", "allele", lambda: F.count_if(col("reverse")))
prepared("n_supplementary", "support", "allele", lambda: F.count_if(col("supplementary")))
prepared("non_match_bases", "support", "allele", lambda: F.sum("read_non_matches"))
prepared("support_bases", "support", "allele", lambda: F.sum(F.length("seq")))
prepared("stdev_error", "support", "allele", lambda: F.stddev_pop(col("read_non_matches") / F.length("seq")))
prepared("median_bq", "support", "allele", lambda: F.median(F.array_min("sec_quals")))
prepared("n_left", "support", "allele", lambda: F.count_if(_spans_half() | ~_in_right_half()))
prepared("n_right", "support", "allele", lambda: F.count_if(_spans_half() | _in_right_half()))
prepared("n_end", "support", "allele", lambda: F.count_if(_contained() & (_in_first_bases() | _in_last_bases())))
prepared("n_middle", "support", "allele", lambda: F.count_if(_contained() & ~(_in_first_bases() | _in_last_bases())))
prepared("n_tail", "support", "allele", lambda: F.count_if(_contained() & _in_tail()))
prepared("n_head", "support", "allele", lambda: F.count_if(_contained() & ~_in_tail()))
prepared("dup_reads", "duplicates", "allele", lambda: F.sum(F.when(col("n_of_group") > 1, col("n_of_group") - 1).otherwise(1)))
prepared("least_concordance", "concordance", "sample", lambda: F.min("concordance"))
prepared("mean_likelihood", "support", "allele", lambda: F.floor(F.avg(F.floor(-col("ln_likelihood") / N.LN10_DIV_10))))
prepared("n_mismatched", "support", "sample", lambda: F.count_if(_section_differs()))
prepared("n_base_mismatches", "support", "sample", lambda: F.sum(F.when(col("sec_part") == col("allele_part"), 0).otherwise(S.hamming(col("sec_part"), col("allele_part")))))
prepared("base_mismatch_quals", "support", "sample", lambda: F.median(_worst_mismatch_quality()))
prepared("n_assigned", "support", "sample", lambda: F.count(F.lit(1)))
prepared("n_misaligned", "support", "sample", lambda: F.count_if((col("read_non_matches") > 0) & (col("read_non_matches") > 5 * F.ceil("expected_errors"))))
prepared("n_ambiguous", "ambiguous", "sample", lambda: F.count(F.lit(1)))
prepared("median_somatic_mq", "support", "sample", lambda: F.median(F.when(col("is_somatic_allele"), col("mq"))))

#: Share of a read's bases that make its head or tail.
END_SHARE = 0.03


def _read() -> R.Region:
    return R.Region(col("read_start"), col("read_end"))


def _call() -> R.Region:
    """The allele's region: that of its call."""
    return R.Region(col("call_start"), col("call_end"))


def with_sections(support: DataFrame) -> DataFrame:
    """Add what measures compare: ``read_non_matches``, bases of a read that its cigar says differ; ``sec`` and ``sec_quals``, a read's bases and qualities on the call's region by its cigar, and the
    parts of ``sec`` and of the allele that stand against each other (from the back if the read begins inside the call)."""
    back = ~_complete() & (col("read_start") >= col("call_start"))
    gapless = col("gapless") if "gapless" in support.columns else None
    x = support.withColumn("_cut", C.section(col("cigar"), col("read_start"), col("call_start"), col("call_end"), gapless=gapless, stop=col("read_end")))
    x = x.withColumn("sec", F.substr("seq", col("_cut.off") + 1, col("_cut.size"))).withColumn("sec_quals", F.slice("quals", col("_cut.off") + 1, F.greatest("_cut.size", F.lit(1))))
    n = F.least(F.length("sec"), F.length("allele_seq"))
    ends = lambda c: F.when(back, F.right(col(c), n)).otherwise(F.left(col(c), n))
    x = x.withColumn("sec_part", ends("sec")).withColumn("allele_part", ends("allele_seq"))
    # of a read, not of a pair: worked out beforehand where the rows bring them
    for name, value in (("read_non_matches", C.sum_non_matches(col("cigar"))), ("expected_errors", expected_errors())):
        x = x.withColumn(name, F.coalesce(name, value) if name in support.columns else value)
    return x.withColumn("sec_skip", F.when(back, F.size("sec_quals") - F.length("sec_part")).otherwise(0)).drop("_cut")


def _complete() -> Column:
    return R.contains(_read(), _call()) & ~R.are_adjacent(_read(), _call())


def _section_differs() -> Column:
    return F.when(_complete(), col("sec") != col("allele_seq")).otherwise((F.length("sec") > F.length("allele_seq")) | (col("sec_part") != col("allele_part")))


def _contained() -> Column:
    return R.contains(_read(), _call())


def _spans_half() -> Column:
    """The allele is so large against the read that it counts for both sides."""
    return _call().size >= F.floor(_read().size / 2)


def _in_right_half() -> Column:
    return R.overlaps(_call(), R.Region(col("read_start") + F.floor(_read().size / 2), col("read_end")))


def _end_bases() -> Column:
    return F.greatest(F.floor(F.length("seq") * END_SHARE), F.lit(1))


def _in_first_bases() -> Column:
    return R.contains(R.head_region(_read(), _end_bases()), _call())


def _in_last_bases() -> Column:
    return R.contains(R.tail_region(_read(), _end_bases()), _call())


def _in_tail() -> Column:
    return F.when(col("reverse"), _in_first_bases()).otherwise(_in_last_bases())


def _worst_mismatch_quality() -> Column:
    """Least quality of the section's bases that differ from the allele."""
    n = F.length("sec_part")
    at = F.when((n > 0) & (col("sec_part") != col("allele_part")), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(at, lambda i: F.substr("sec_part", i, F.lit(1)) != F.substr("allele_part", i, F.lit(1)))
    return F.array_min(F.transform(hits, lambda i: F.get("sec_quals", i - 1 + col("sec_skip"))))


def expected_errors() -> Column:
    """Sum of 10**(-q/10) with the exponent divided as an integer."""
    return F.aggregate("quals", F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -F.floor(q / 10)))


# --- level call ---
measure("QUAL", "Quality", "call", lambda: col("qual"))
measure("PP", "PosteriorProbability", "call", lambda: col("pp"))
measure("PPP", "PhylogenyPosterior", "call", lambda: col("ppp"))
measure("CC", "ClassificationConfidence", "call", lambda: F.when(col("qual").isNull() | col("pp").isNull(), F.lit(None)).when(
    col("qual") <= 0, F.lit(0.0)).otherwise(col("pp") / col("qual")))
measure("CRF", "ClippedReadFraction", "call", lambda: F.when(col("n_all") > 0, col("n_clipped") / col("n_all")), inputs=("n_all", "n_clipped"))
measure("MQ0", "MappingQualityZeroCount", "call", lambda: F.coalesce("n_mq_zero", F.lit(0)), inputs=("n_mq_zero",))
measure("MQ", "MeanMappingQuality", "call", lambda: F.when(col("n_all") > 0, F.sqrt(col("sum_mq_squares") / col("n_all"))), inputs=("n_all", "sum_mq_squares"))
measure("GC", "GCContent", "call", lambda: S.gc_content(col("context")))
measure("STRL", "STRLength", "call", lambda: F.coalesce(col("repeat.end_pos") - col("repeat.start_pos"), F.lit(0)))
measure("STRP", "STRPeriod", "call", lambda: F.coalesce(col("repeat.period"), F.lit(0)))
measure("DC", "DeNovoContamination", "call", lambda: F.when(col("is_denovo"), col("denovo_contamination")))
measure("NC", "NormalContamination", "call", lambda: F.when(col("is_somatic"), col("normal_contamination")))
# --- level sample ---
_depth = lambda: F.coalesce("max_depth", F.lit(0))
_raw_depth = lambda: F.coalesce("max_raw_depth", F.lit(0))
_by = lambda x, n: F.when(n() > 0, x / n())
measure("DP", "Depth", "sample", _depth, inputs=("max_depth",))
measure("QD", "QualityByDepth", "sample", lambda: _by(col("qual"), _depth), inputs=("max_depth",))
measure("GQ", "GenotypeQuality", "sample", lambda: col("gq").cast("double"))
measure("GQD", "GenotypeQualityByDepth", "sample", lambda: _by(col("gq").cast("double"), _depth), inputs=("max_depth",))
measure("PPD", "PosteriorProbabilityByDepth", "sample", lambda: _by(col("pp"), _depth), inputs=("max_depth",))
measure("MP", "ModelPosterior", "sample", lambda: F.coalesce("gt_mp", "mp"))
measure("MPD", "ModelPosteriorByDepth", "sample", lambda: _by(F.coalesce("gt_mp", "mp"), _depth), inputs=("max_depth",))
measure("FRF", "FilteredReadFraction", "sample", lambda: F.when(_raw_depth() > 0, 1 - _depth() / _raw_depth()).otherwise(0.0), inputs=("max_depth", "max_raw_depth"))
measure("MRL", "MaxReadLength", "sample", lambda: col("max_read_length"), inputs=("max_read_length",))
measure("ARF", "AmbiguousReadFraction", "sample", lambda: F.when(col("n_overlapping") > 0, F.coalesce("n_ambiguous", F.lit(0)) / col("n_overlapping")),
        inputs=("n_overlapping", "n_ambiguous"))
measure("SD", "StrandDisequilibrium", "sample", lambda: F.get(N.beta_cdfs(F.array(F.array(
    F.coalesce("all_forward", F.lit(0)) + 0.5, F.coalesce("all_reverse", F.lit(0)) + 0.5, F.lit(0.01), F.lit(0.99)))), F.lit(0)), inputs=("all_forward", "all_reverse"))
measure("DENOVO", "IsDenovo", "sample", lambda: col("is_denovo") & F.coalesce("is_child", F.lit(False)))
measure("REFCALL", "IsRefcall", "sample", lambda: F.forall("gt", lambda g: g == 0))
measure("SOMATIC", "IsSomatic", "sample", lambda: col("is_somatic") & (F.size("gt") > col("ploidy")) & F.exists("gt", lambda g: g > 0))
measure("SHC", "SomaticHaplotypeCount", "sample", lambda: F.when(col("is_somatic"), F.greatest(F.size("gt") - col("ploidy"), F.lit(0))).otherwise(0))
measure("PLN", "PhaseLength", "sample", lambda: col("phase_length"))
measure("VL", "VariantLength", "sample", lambda: F.array_max(F.transform("gt", lambda g: F.greatest(
    F.length(F.get(F.concat(F.array("ref"), col("alts")), g)), (col("end_pos") - col("start_pos")).cast("int")))))
measure("ADP", "AssignedDepth", "sample", lambda: F.coalesce("n_assigned", F.lit(0)), inputs=("n_assigned",))
measure("MC", "MismatchCount", "sample", lambda: F.coalesce("n_mismatched", F.lit(0)), inputs=("n_mismatched",))
measure("MF", "MismatchFraction", "sample", lambda: F.when(_depth() > 0, F.coalesce("n_mismatched", F.lit(0)) / _depth()).otherwise(0.0), inputs=("n_mismatched", "max_depth"))
measure("BMC", "BaseMismatchCount", "sample", lambda: F.coalesce("n_base_mismatches", F.lit(0)), inputs=("n_base_mismatches",))
measure("BMF", "BaseMismatchFraction", "sample", lambda: (lambda n: F.when(n > 0, F.coalesce("n_base_mismatches", F.lit(0)) / n).otherwise(0.0))(
    _depth() * MEASURES["VL"].value()), inputs=("n_base_mismatches", "max_depth"))
measure("BMQ", "BaseMismatchQuality", "sample", lambda: F.floor("base_mismatch_quals").cast("int"), inputs=("base_mismatch_quals",))
measure("MRC", "MisalignedReadCount", "sample", lambda: F.coalesce("n_misaligned", F.lit(0)), inputs=("n_misaligned",))
measure("SMQ", "MedianSomaticMappingQuality", "sample", lambda: F.when(col("is_somatic"), col("median_somatic_mq")), inputs=("median_somatic_mq",))
# --- level allele, and samples from arrays over alleles ---
_called = lambda: F.array_contains("gt", col("allele"))
_copies = lambda: F.size(F.filter("gt", lambda g: g == col("allele")))
_support = lambda: F.when(_called(), F.coalesce("n_support", F.lit(0)))
measure("AD", "AlleleDepth", "allele", _support, inputs=("n_support",), aggregator="min_tail")
measure("AF", "AlleleFrequency", "allele", lambda: F.when(_called(), F.when(F.coalesce("n_assigned", F.lit(0)) == 0, 1.0).otherwise(_support() / col("n_assigned"))),
        inputs=("n_support", "n_assigned"), aggregator="min_tail")
measure("AFB", "AlleleFrequencyBias", "allele", lambda: F.abs(_copies() / F.size("gt") - MEASURES["AF"].value()),
        inputs=("n_support", "n_assigned"), aggregator="min_tail")
measure("AMQ", "AlleleMappingQuality", "allele", lambda: col("median_mq"), inputs=("median_mq",), aggregator="min_tail")
measure("AC", "AltAlleleCount", "allele", lambda: F.when(col("allele") > 0, _copies()), aggregator="sum")
measure("BQ", "MedianBaseQuality", "allele", lambda: F.when(F.length("allele_seq") == F.length("ref"), F.floor("median_bq").cast("int")), inputs=("median_bq",), aggregator="min_tail")
measure("DAD", "DuplicateAlleleDepth", "allele", lambda: F.when(_called(), F.coalesce("dup_reads", F.lit(0))), inputs=("dup_reads",), aggregator="max_tail")
measure("DAF", "DuplicateAlleleFraction", "allele", lambda: F.when(_called(), F.when(_support() > 0, F.coalesce("dup_reads", F.lit(0)) / _support()).otherwise(0.0)),
        inputs=("dup_reads", "n_support"), aggregator="max_tail")
measure("ER", "ErrorRate", "allele", lambda: F.when(col("support_bases") > 0, col("non_match_bases") / col("support_bases")), inputs=("non_match_bases", "support_bases"), aggregator="max")
measure("ERS", "ErrorRateStdev", "allele", lambda: col("stdev_error"), inputs=("stdev_error",), aggregator="max")
measure("ITV", "IsTransversion", "allele", lambda: F.when(col("allele") > 0, A.is_transversion(col("ref"), col("allele_seq"))), aggregator="max")
measure("MHL", "MeanLikelihood", "allele", lambda: col("mean_likelihood"), inputs=("mean_likelihood",), aggregator="max")

#: Measures of a sample that compare its alleles; computed from arrays of the allele-level aggregates.
ACROSS: dict[str, tuple[str, tuple[str, ...], Callable[[], Column]]] = {}


def across(name: str, title: str, inputs: tuple[str, ...], value: Callable[[], Column]) -> None:
    ACROSS[name] = (title, inputs, value)


def _pairs(xs: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.array_max(F.flatten(F.transform(xs, lambda a: F.transform(xs, lambda b: fn(a, b)))))


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def _own() -> Column:
    """Cells of the alleles that the sample is called with."""
    return F.filter("own", lambda x: F.array_contains("gt", x["allele"]))


def _n(x: Column, name: str) -> Column:
    return F.coalesce(x[name], F.lit(0)).cast("double")


def _het() -> Column:
    return F.size(F.array_distinct("gt")) > 1


def _most(test: Callable[[Column], Column]) -> Column:
    """Largest value over called alleles; 0 for none."""
    return F.coalesce(F.array_max(F.transform(_own(), test)), F.lit(0.0))


def _medians() -> Column:
    return F.transform(F.filter(_own(), lambda x: x["median_mq"].isNotNull()), lambda x: F.floor(x["median_mq"]).cast("int"))


across("MQD", "MappingQualityDivergence", ("median_mq",), lambda: F.when(_het(), F.array_max(_medians()) - F.array_min(_medians())))
across("SB", "StrandBias", ("n_forward", "n_reverse"), lambda: F.when(_het() & F.exists("gt", lambda g: g > 0), N.largest_beta_difference(F.transform(
    _own(), lambda x: F.array(_n(x, "n_forward") + 1, _n(x, "n_reverse") + 1)))))
across("RSB", "ReadSideBias", ("n_left", "n_right"), lambda: F.array_max(F.concat(F.array(F.lit(0.0)), N.beta_cdfs(F.transform(_own(), lambda x: F.array(
    _n(x, "n_left") + 1, _n(x, "n_right") + 1, F.lit(0.25), F.lit(0.75)))))))
across("REB", "ReadEndBias", ("n_middle", "n_end"), lambda: F.array_max(F.concat(F.array(F.lit(0.0)), N.beta_cdfs(F.transform(_own(), lambda x: F.array(
    _n(x, "n_middle") + 1, _n(x, "n_end") + 1, F.lit(min(3 * END_SHARE, 0.5)), F.lit(1.0)))))))
across("RTB", "ReadTailBias", ("n_head", "n_tail"), lambda: F.array_max(F.concat(F.array(F.lit(0.0)), N.beta_cdfs(F.transform(_own(), lambda x: F.array(
    _n(x, "n_head") + 1, _n(x, "n_tail") + 1, F.lit(min(3 * END_SHARE, 0.5)), F.lit(1.0)))))))
across("SF", "SupplementaryFraction", ("n_support", "n_supplementary"), lambda: F.when(F.exists("gt", lambda g: g > 0), F.aggregate(
    F.filter(_own(), lambda x: x["allele"] > 0), F.lit(0.0), lambda s, x: s + F.when(_n(x, "n_support") > 0, F.greatest(s, _n(x, "n_supplementary") / _n(x, "n_support"))).otherwise(0.0))))
measure("DPC", "DuplicateConcordance", "sample", lambda: F.when(F.exists("gt", lambda g: g > 0), col("least_concordance")), inputs=("least_concordance",))

ALL = [*MEASURES, *ACROSS]


def aggregate_alleles(values: Column, how: str) -> Column:
    """One value from an array over alleles (index 0 is the reference); nulls are dropped, nothing left gives null."""
    kept = F.filter(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))) if how.endswith("_tail") else values, lambda v: v.isNotNull())
    out = {"sum": lambda: F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), "mean": lambda: F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept),
           "min": lambda: F.array_min(kept), "max": lambda: F.array_max(kept)}[how.removesuffix("_tail")]()
    return F.when(F.size(kept) > 0, out)


@dataclass
class Facets:
    """The tables measures are computed from; reads and support may be left out if no measure needs them."""

    calls: DataFrame
    genotypes: DataFrame
    reads: DataFrame | None = None
    raw_reads: DataFrame | None = None
    support: DataFrame | None = None
    ambiguous: DataFrame | None = None
    width: int = 128
    built: dict[str, DataFrame] = field(default_factory=dict)

    def rows(self, facet: str) -> DataFrame:
        if facet not in self.built:
            self.built[facet] = self._build(facet)
        return self.built[facet]

    def _build(self, facet: str) -> DataFrame:
        if facet == "reads":  # for the longest read: one row a region and sample
            shapes = self.reads.groupBy("sample", "contig", "start_pos", "end_pos").agg(F.max(F.length("seq")).alias("length"))
            return self._overlapping(self.calls.select("call_id", "contig", "start_pos", "end_pos"), shapes)
        if facet in ("depth", "raw_depth"):
            reads = self.reads if facet == "depth" else self.raw_reads
            # an empty call looks at the position it is at
            calls = self.calls.select("call_id", "contig", "start_pos", F.greatest(col("end_pos"), col("start_pos") + 1).alias("end_pos"))
            return self._overlapping(calls, depth_runs(reads, ["sample", "contig"]))
        if facet == "support":
            called = self.genotypes.select("call_id", "sample", F.explode(F.array_distinct("gt")).alias("allele"))
            return with_sections(self.support.join(called.hint("merge"), _KEYS["allele"]))
        if facet == "concordance":
            # of each group of duplicates: how evenly its reads (by name) are spread over alleles, from 1 (one allele) to 0
            cells = self.rows("support").where("dup_group is not null").groupBy(*_KEYS["allele"], "dup_group").agg(F.countDistinct("name").alias("n"))
            groups = cells.groupBy(*_KEYS["sample"], "dup_group").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum(col("n") * F.log2("n")).alias("weighted"))
            entropy = F.log2("all") - col("weighted") / col("all")
            return groups.withColumn("concordance", F.when(col("k") < 2, F.lit(1.0)).otherwise(1 - F.least(entropy, F.lit(1.0))))
        if facet == "duplicates":
            groups = self.rows("support").where("dup_group is not null").groupBy(*_KEYS["allele"], "dup_group")
            return groups.agg(F.count(F.lit(1)).alias("n_of_group"))
        return getattr(self, facet)

    def sums(self, level: str, names: list[str]) -> DataFrame:
        """:data:`SUMS` over the reads that overlap a call, by call (and sample)."""
        place = self.calls.select("call_id", "contig", "start_pos", "end_pos")
        if level == "sample":
            place = place.join(self.genotypes.select("call_id", "sample").hint("merge"), "call_id")
        x = sum_overlapped(place, self.reads, {n: SUMS[n]() for n in names}, on=("sample", "contig") if level == "sample" else ("contig",))
        return x.select(*_KEYS[level], *names)

    def _overlapping(self, calls: DataFrame, items: DataFrame) -> DataFrame:
        x = interval_join(calls, items, width=self.width)
        return x.withColumn("call_id", col("l.call_id")).withColumn("sample", col("r.sample"))


_KEYS = {"call": ["call_id"], "sample": ["call_id", "sample"], "allele": ["call_id", "sample", "allele"]}
#: Columns of calls and genotypes that measures may read, with the value they have if the input lacks them.
_OPTIONAL = {"pp": "double", "ppp": "double", "mp": "double", "context": "string", "denovo_contamination": "double", "normal_contamination": "double",
             "repeat": "struct<start_pos:bigint,end_pos:bigint,period:int>", "is_denovo": "boolean", "is_somatic": "boolean"}
_OPTIONAL_GT = {"gq": "int", "gt_mp": "double", "ploidy": "int", "phase_length": "bigint", "is_child": "boolean"}


def _fill(df: DataFrame, optional: dict[str, str]) -> DataFrame:
    for c, kind in optional.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(False) if kind == "boolean" else F.lit(None).cast(kind))
    return df


def evaluate(facets: Facets, names: Iterable[str]) -> DataFrame:
    """One row per call and sample: measures of level call and sample as values, of level allele as arrays over alleles 0, 1, ..."""
    names = list(names)
    own = [MEASURES[n] for n in names if n in MEASURES]
    cross = [n for n in names if n in ACROSS]
    inputs = list(dict.fromkeys([i for m in own for i in m.inputs] + [i for n in cross for i in ACROSS[n][1]]))
    calls = _fill(facets.calls, _OPTIONAL)
    # rows that explode are more than the planner's statistics say: no side of these joins is broadcast
    base = _fill(facets.genotypes, _OPTIONAL_GT).hint("merge").join(calls, "call_id")
    for level in ("call", "sample"):
        sums = [i for i in inputs if i in SUMS and PREPARED[i].level == level]
        if sums:
            base = base.join(facets.sums(level, sums).hint("merge"), _KEYS[level], "left")
        for facet in dict.fromkeys(PREPARED[i].facet for i in inputs if PREPARED[i].level == level and i not in SUMS):
            aggs = [PREPARED[i].value().alias(i) for i in inputs if (PREPARED[i].level, PREPARED[i].facet) == (level, facet) and i not in SUMS]
            base = base.join(facets.rows(facet).groupBy(*_KEYS[level]).agg(*aggs).hint("merge"), _KEYS[level], "left")
    per_sample = [m.value().alias(m.name) for m in own if m.level != "allele"]
    by_allele = [m for m in own if m.level == "allele"]
    allele_inputs = [i for i in inputs if PREPARED[i].level == "allele"]
    if not by_allele and not cross:
        return base.select("call_id", "sample", *per_sample)
    seqs = F.concat(F.array("ref"), col("alts"))
    x = base.select("*", F.posexplode(seqs).alias("allele", "allele_seq"))
    for facet in dict.fromkeys(PREPARED[i].facet for i in allele_inputs):
        aggs = [PREPARED[i].value().alias(i) for i in allele_inputs if PREPARED[i].facet == facet]
        x = x.join(facets.rows(facet).groupBy(*_KEYS["allele"]).agg(*aggs).hint("merge"), _KEYS["allele"], "left")
    cells = F.sort_array(F.collect_list(F.struct("allele", *[m.value().alias(m.name) for m in by_allele], *allele_inputs)))
    first = [F.first(c).alias(c) for c in dict.fromkeys([m.name for m in own if m.level != "allele"] + ["gt"])]
    x = x.select("call_id", "sample", "gt", *per_sample, "allele", "allele_seq", "ref", *[c for c in x.columns if c in {*allele_inputs, "n_assigned"}])
    x = x.groupBy("call_id", "sample").agg(*first, cells.alias("own"))
    return x.select("call_id", "sample", *[col(m.name) for m in own if m.level != "allele"],
                    *[_field("own", m.name).alias(m.name) for m in by_allele], *[ACROSS[n][2]().alias(n) for n in cross])
