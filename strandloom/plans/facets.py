"""Facets of calls that measures read: reference and repeat context, phase blocks, contamination, allele support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import cigar as C
from ..functions import regions as R
from ..operators.interval import interval_join
from ..sources.text_formats import CHUNK, fetch_sequences

col = F.col
#: Positions on each side of a call that make its context.
MARGIN = 50


def with_reference_context(calls: DataFrame, reference: DataFrame, *, margin: int = MARGIN, chunk: int = CHUNK) -> DataFrame:
    """Add ``context``: the reference from ``margin`` positions before the call to as many behind it."""
    around = calls.select("call_id", "contig", F.greatest(col("start_pos") - margin, F.lit(0)).alias("start_pos"), (col("end_pos") + margin).alias("end_pos"))
    found = fetch_sequences(around, reference, chunk=chunk, id_cols=["call_id"]).select("call_id", col("ref_seq").alias("context"))
    return calls.join(found, "call_id", "left")


def called_region(call: R.Region, ref: Column, alts: Column, allele: Column) -> R.Region:
    """Where an allele differs from the call's region: behind the reference base that pads indels."""
    seq = F.get(F.concat(F.array(ref), alts), allele)
    same = lambda x: (F.length(x) != F.length(ref)) & (F.substring(x, 1, 1) == F.substring(ref, 1, 1))
    pad = F.when(F.when(allele == 0, F.exists(alts, same)).otherwise(same(seq)), 1).otherwise(0)
    return R.Region(call.begin + pad, call.end)


def with_repeat_context(calls: DataFrame, repeats: DataFrame, genotypes: DataFrame, **options) -> DataFrame:
    """Add ``repeat`` (``start_pos, end_pos, period``): the tandem repeat a call lies in; null if there is none.

    Of the repeats that contain the call (up to one position) and overlap an allele that some sample is called with, the one
    with the largest overlap, then the last end, then the first begin.  Failing those, the repeat of largest overlap with
    the call, unless a called allele overlaps it.
    """
    called = genotypes.select("call_id", F.explode("gt").alias("g")).groupBy("call_id").agg(F.collect_set("g").alias("_called"))
    wide = calls.join(called, "call_id", "left").select("call_id", "contig", "ref", "alts", "_called", col("start_pos").alias("_b"), col("end_pos").alias("_e"),
                                                        F.greatest(col("start_pos") - 1, F.lit(0)).alias("start_pos"), (col("end_pos") + 1).alias("end_pos"))
    x = interval_join(wide, repeats.select("contig", "start_pos", "end_pos", "period"), spread=True, **options)
    call, rep = R.Region(col("l._b"), col("l._e")), R.Region.of("r")
    hit = F.coalesce(F.exists("l._called", lambda g: R.overlaps(called_region(call, col("l.ref"), col("l.alts"), g), rep)), F.lit(False))
    padded = R.Region(F.greatest(rep.begin - 1, F.lit(0)), rep.end)
    inside = R.contains(R.expand(rep, 1), call)
    cell = F.struct(rep.begin.alias("start_pos"), rep.end.alias("end_pos"), col("r.period").alias("period"))
    order = F.struct(R.overlap_size(padded, call).alias("o"), rep.end.alias("e"), (-rep.begin).alias("b"), (-col("r.period")).alias("p"))
    most = F.struct(R.overlap_size(rep, call).alias("o"), (-rep.begin).alias("b"), (-rep.end).alias("e"), (-col("r.period")).alias("p"))
    found = x.groupBy(col("l.call_id").alias("call_id")).agg(
        F.max_by(cell, F.when(inside & hit, order)).alias("_in"), F.max_by(F.struct(cell.alias("r"), hit.alias("hit")), F.when(R.overlaps(rep, call), most)).alias("_most"))
    chosen = F.coalesce("_in", F.when(~col("_most.hit"), col("_most.r")))
    return calls.join(found.select("call_id", chosen.alias("repeat")), "call_id", "left")


def with_phase_length(genotypes: DataFrame, calls: DataFrame, keys: list[str] = ("sample", "contig", "phase_set")) -> DataFrame:
    """Add ``phase_length``: the span of the calls in the genotype's phase set; of the call alone if it has none."""
    keys = list(keys)
    x = genotypes.join(calls.select("call_id", "contig", "start_pos", "end_pos"), "call_id")
    spans = x.where("phase_set is not null").groupBy(*keys).agg((F.max("end_pos") - F.min("start_pos")).alias("_span"))
    out = x.join(spans, keys, "left").withColumn("phase_length", F.coalesce("_span", col("end_pos") - col("start_pos")))
    return out.select(*genotypes.columns, "phase_length")


def suspects(genotypes: DataFrame, watched: Column) -> DataFrame:
    """``call_id, suspect_ids``: haplotypes of the other samples that no ``watched`` sample (parents, normals) is called with."""
    x = genotypes.select("call_id", F.explode("haplotype_ids").alias("h"), watched.alias("w")).groupBy("call_id", "h").agg(F.bool_or("w").alias("own"))
    return x.groupBy("call_id").agg(F.array_sort(F.collect_list(F.when(~col("own"), col("h")))).alias("suspect_ids"))


def contamination(likelihoods: DataFrame, genotypes: DataFrame, suspect_haplotypes: DataFrame, *, ln_prior: float = -1.0, eps: float = 1e-9) -> DataFrame:
    """``call_id, contamination``: the share of the reads of ``genotypes``' samples that prefer a suspect haplotype; 0 without reads.

    A read goes to the called haplotype of largest likelihood.  It is then compared with the suspects, which have a
    prior of ``ln_prior``; a read that has no single best called haplotype is compared with all of them.  Ties are no
    preference.  A call without suspects has no value.
    """
    best = lambda xs: (lambda m: F.filter(xs, lambda x: F.abs(x["v"] - m) < eps))(F.array_max(F.transform(xs, lambda x: x["v"])))
    own = genotypes.select("call_id", "sample", "haplotype_ids")
    x = likelihoods.groupBy("call_id", "sample", "read_id").agg(F.collect_list(F.struct(col("haplotype_id").alias("h"), col("ln_p").alias("v"))).alias("all"))
    x = x.join(own, ["call_id", "sample"]).join(suspect_haplotypes, "call_id").where(F.size("suspect_ids") > 0)
    called = best(F.filter("all", lambda c: F.array_contains("haplotype_ids", c["h"])))
    x = x.withColumn("_own", F.transform(called, lambda c: c["h"]))
    single = F.size("_own") == 1
    rivals = F.transform(F.filter("all", lambda c: F.array_contains("suspect_ids", c["h"]) | F.when(single, c["h"] == F.get("_own", F.lit(0))).otherwise(
        F.array_contains("haplotype_ids", c["h"]))), lambda c: F.struct(
            c["h"].alias("h"), (c["v"] + F.when(F.array_contains("suspect_ids", c["h"]), ln_prior).otherwise(0.0)).alias("v")))
    x = x.withColumn("_top", best(rivals))
    prefers = F.when(single & F.array_contains("suspect_ids", F.get("_own", F.lit(0))), True).otherwise(
        (F.size("_top") == 1) & F.array_contains("suspect_ids", F.get(col("_top.h"), F.lit(0))))
    shares = x.groupBy("call_id").agg((F.count_if(prefers) / F.count(F.lit(1))).alias("share"))
    return suspect_haplotypes.where(F.size("suspect_ids") > 0).join(shares, "call_id", "left").select("call_id", F.coalesce("share", F.lit(0.0)).alias("contamination"))


def sequence_support(calls: DataFrame, reads: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(support, ambiguous): the allele whose bases a read shows on the call's region; reads that show none are ambiguous.

    The direct form for calls whose alleles can be told apart by the bases alone, without an alignment to haplotypes.
    """
    reads = reads.withColumn("gapless", C.is_gapless(col("cigar")))
    x = interval_join(calls, reads, **options)
    cut = C.section(col("r.cigar"), col("r.start_pos"), col("l.start_pos"), col("l.end_pos"), gapless=col("r.gapless"), stop=col("r.end_pos"))
    shown = F.substr("r.seq", cut["off"] + 1, cut["size"])
    alleles = F.concat(F.array("l.ref"), col("l.alts"))
    x = x.withColumn("allele", (F.array_position(alleles, shown) - 1).cast("int"))
    rows = support_rows(x.where("allele >= 0"))
    return rows, x.where("allele < 0").select(col("l.call_id").alias("call_id"), col("r.sample").alias("sample"))


def support_rows(pairs: DataFrame) -> DataFrame:
    """Rows of the facet ``support`` from pairs ``l`` (call), ``r`` (read) with ``allele``; absent read columns are null."""
    have = set(pairs.schema["r"].dataType.names)
    opt = lambda c, kind: (col(f"r.{c}") if c in have else F.lit(None).cast(kind)).alias(c)
    return pairs.select("l.call_id", col("l.start_pos").alias("call_start"), col("l.end_pos").alias("call_end"), "r.sample", "allele",
                        F.get(F.concat(F.array("l.ref"), col("l.alts")), col("allele")).alias("allele_seq"), col("r.start_pos").alias("read_start"),
                        col("r.end_pos").alias("read_end"), "r.seq", "r.quals", "r.cigar", "r.mq", "r.reverse", "r.supplementary", opt("dup_group", "bigint"),
                        opt("gapless", "boolean"), opt("name", "string"), opt("read_non_matches", "int"), opt("expected_errors", "double"), opt("ln_likelihood", "double"), opt("is_somatic_allele", "boolean"))


def indel_padded(ref: Column, alts: Column) -> Column:
    """Whether the record's first base only pads an indel."""
    return F.exists(alts, lambda a: A.is_indel(ref, a) & (F.substring(a, 1, 1) == F.substring(ref, 1, 1)))
