"""End-to-end callers: reads and reference to call records.

The stages are DataFrames: candidates, blocks, haplotypes, likelihoods, posteriors, calls.  Everything is keyed by block, so
that a block's data meet once by shuffle; each model is a different plan over the same likelihood table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import reads as P
from ..operators.interval import interval_join
from ..sources.store import cut as _cut
from ..sources.text_formats import fetch_sequences
from . import candidates as K
from . import genotypes as G
from . import haplotypes as H
from . import mixtures as Mx
from . import mutation as T
from .haplotypes import repeat_table
from .likelihoods import read_likelihoods

col = F.col


@dataclass(frozen=True)
class Options:
    """The calling options with their defaults; file, thread and memory settings belong to Spark."""

    ploidy: int = 2
    min_mapping_quality: int = 5
    min_base_quality: int = 20
    good_base_quality: int = 20
    min_good_bases: int = 20
    max_read_length: int = 10000
    duplicate_policy: str | None = "relaxed"
    downsample_above: int = 1000
    downsample_target: int = 500
    min_supporting_reads: int = 2
    min_candidate_frequency: float = 0.1
    use_assembler: bool = False
    kmer_sizes: tuple[int, ...] = (10, 15, 20)
    assembly_bin: int = 600
    assembly_overlap: int = 200
    max_fallback_kmers: int = 10
    fallback_kmer_gap: int = 10
    max_bubbles: int = 30
    min_bubble_score: float = 2.0
    max_haplotypes: int = 200
    snp_heterozygosity: float = 0.001
    indel_heterozygosity: float = 0.0001
    min_variant_posterior: float = 0.1
    min_phase_score: float = 5.0
    max_genotype_combinations: int = 100
    min_somatic_posterior: float = 0.5
    min_denovo_posterior: float = 3.0
    somatic_prior: float = 1e-4
    denovo_prior: float = 1.3e-8
    denovo_indel_prior: float = 1e-9
    somatic_indel_prior: float = 1e-6
    tumour_germline_concentration: float = 1.5
    max_vb_seeds: int = 12
    dropout: float = 0.05
    max_cell_groups: int = 3
    max_clones: int = 5
    min_clone_frequency: float = 0.01
    clone_concentration: float = 1.0
    disable_preprocessing: bool = False
    read_filters: tuple[str, ...] = field(default=P.DEFAULT)


def preprocess(reads: DataFrame, o: Options) -> DataFrame:
    """Filters, masks and downsampling in the order of the read pipeline."""
    if o.disable_preprocessing:
        return P.apply_filters(reads, P.MANDATORY)
    params = {"is_good_mapping_quality": (o.min_mapping_quality,), "has_sufficient_good_quality_bases": (o.good_base_quality, o.min_good_bases), "is_short": (o.max_read_length,)}
    x = P.apply_filters(P.capitalise_bases(reads), o.read_filters, params)
    if o.duplicate_policy:
        x = P.remove_duplicates(x, policy=o.duplicate_policy)
    x = _cut(P.mask_adapters(x))
    return P.downsample(x, trigger=o.downsample_above, target=o.downsample_target)


def candidate_variants(reads: DataFrame, reference: DataFrame, o: Options, sources: DataFrame | None = None) -> DataFrame:
    """Union of pileup, assembly and given candidates: ``contig, start_pos, end_pos, ref, alt``."""
    with_ref = fetch_sequences(reads, reference, id_cols=["name", "sample", "contig", "start_pos", "end_pos", "first_segment"])
    seen = _cut(K.observation_stats(K.cigar_candidates(_cut(with_ref), min_base_quality=o.min_base_quality)))
    depth = interval_join(seen.select("contig", "start_pos", "end_pos", "sample", "ref", "alt"), reads.select("contig", "start_pos", "end_pos", "sample"), on=("contig", "sample"))
    depth = depth.groupBy("l.contig", "l.start_pos", "l.end_pos", "l.sample", "l.ref", "l.alt").agg(F.count(F.lit(1)).alias("depth"))
    x = seen.join(depth, ["contig", "start_pos", "end_pos", "sample", "ref", "alt"])
    out = x.where(K.include_germline(col("depth"), min_obs=o.min_supporting_reads, min_frequency=o.min_candidate_frequency)).select("contig", "start_pos", "end_pos", "ref", "alt")
    if o.use_assembler:
        out = out.unionByName(_assembled(reads, reference, o))
    if sources is not None:
        out = out.unionByName(sources.select("contig", "start_pos", "end_pos", "ref", "alt"))
    return out.distinct()


def _assembled(reads: DataFrame, reference: DataFrame, o: Options) -> DataFrame:
    """Candidates by assembly of overlapping bins; bins without any from the given sizes of windows are tried with larger ones."""
    step = o.assembly_bin - o.assembly_overlap
    binned = _cut(reads.select("contig", "seq", F.explode(F.sequence(F.greatest(F.floor((col("start_pos") - o.assembly_overlap) / step), F.lit(0)), F.floor(col("start_pos") / step))).alias("bin")))

    def one(rows: DataFrame, sizes: list[int]) -> DataFrame:
        bins = H.assembly_edges(rows, sizes).withColumn("start_pos", col("bin") * step).withColumn("end_pos", col("bin") * step + o.assembly_bin)
        return H.assembly_candidates(fetch_sequences(bins, reference, id_cols=["contig", "start_pos", "end_pos", "k"]).select("contig", "start_pos", "ref_seq", "k", "edges"), max_bubbles=o.max_bubbles, min_score=o.min_bubble_score)

    base = _cut(one(binned, list(o.kmer_sizes)))
    if not o.max_fallback_kmers:
        return base
    hit = base.select("contig", F.explode(F.sequence(F.greatest(F.floor((col("start_pos") - o.assembly_bin + 1) / step), F.lit(0)), F.floor(col("start_pos") / step))).alias("bin")).distinct()
    larger = [max(o.kmer_sizes) + o.fallback_kmer_gap * i for i in range(1, o.max_fallback_kmers + 1)]
    return base.unionByName(one(binned.join(hit, ["contig", "bin"], "left_anti"), larger))


@dataclass
class Blocks:
    blocks: DataFrame
    haplotypes: DataFrame
    likelihoods: DataFrame


def infer_blocks(reads: DataFrame, reference: DataFrame, candidates: DataFrame, o: Options) -> Blocks:
    """Active blocks, their haplotypes, and the likelihood of each overlapping read under each haplotype."""
    blocks = _cut(fetch_sequences(_cut(H.active_blocks(_cut(candidates))), reference, id_cols=["block_id"]))
    haps = _cut(H.block_haplotypes(H.with_read_windows(blocks, reads, max_haplotypes=o.max_haplotypes), max_haplotypes=o.max_haplotypes))
    over = interval_join(blocks.drop("variants", "ref_seq"), reads)
    # a read is aligned with the part of it that lies in the block, a few bases around included
    lead = F.greatest(col("l.start_pos") - col("r.start_pos"), F.lit(0)).cast("int")
    size = (F.least("l.end_pos", "r.end_pos") - F.greatest("l.start_pos", "r.start_pos")).cast("int")
    read_id = F.xxhash64("r.name", "r.start_pos", "r.end_pos", "r.first_segment", "r.seq")
    inside = over.select("l.block_id", "r.sample", read_id.alias("read_id"), "r.mq", F.substr("r.seq", lead + 1, size).alias("seq"), F.slice("r.quals", lead + 1, size).alias("quals")).where("length(seq) > 5")
    pairs = inside.join(haps.select("block_id", "haplotype_id", "hap_seq"), "block_id").repartition("block_id").sortWithinPartitions("block_id", "haplotype_id")
    return Blocks(blocks, haps, _cut(read_likelihoods(pairs)))


def _ln_prior(b: Blocks, gts: DataFrame, o: Options) -> DataFrame:
    """Genotype prior: each distinct alternative allele of a genotype costs its class's heterozygosity."""
    alleles = b.haplotypes.select("block_id", "haplotype_id", F.explode_outer("allele_ids").alias("allele_id"))
    cost = b.blocks.select("block_id", F.posexplode("variants").alias("allele_id", "v")).select("block_id", "allele_id", F.when(
        F.length("v.ref") == F.length("v.alt"), math.log(o.snp_heterozygosity)).otherwise(math.log(o.indel_heterozygosity)).alias("ln_cost"))
    used = gts.select("block_id", "haplotype_ids", F.explode("haplotype_ids").alias("haplotype_id")).join(alleles, ["block_id", "haplotype_id"]).select("block_id", "haplotype_ids", "allele_id").distinct()
    return used.join(cost, ["block_id", "allele_id"], "left").groupBy("block_id", "haplotype_ids").agg(F.coalesce(F.sum("ln_cost"), F.lit(0.0)).alias("ln_prior"))


def _records(b: Blocks, best: DataFrame, alleles: DataFrame, o: Options, kind: str = "germline") -> DataFrame:
    """Call rows: one per variant and sample whose allele posterior reaches the threshold."""
    variants = b.blocks.select("block_id", "contig", F.posexplode("variants").alias("allele_id", "v"))
    carriers = b.haplotypes.select("block_id", "haplotype_id", "allele_ids")
    gts = best.select("block_id", "sample", "gq", "haplotype_ids", F.posexplode("haplotype_ids").alias("i", "haplotype_id")).join(carriers, ["block_id", "haplotype_id"])
    gts = gts.groupBy("block_id", "sample", "gq").agg(F.array_sort(F.collect_list(F.struct("i", "allele_ids"))).alias("haps"))
    x = alleles.where(N.probability_true_to_phred(col("posterior")) >= o.min_variant_posterior).where("posterior > 0.5").join(variants, ["block_id", "allele_id"]).join(gts, ["block_id", "sample"])
    gt = F.transform("haps", lambda h: F.array_contains(h["allele_ids"], col("allele_id")).cast("int"))
    return x.select("contig", "v.start_pos", "v.end_pos", "v.ref", "v.alt", "sample", F.round(N.probability_true_to_phred(col("posterior")), 2).alias("qual"), gt.alias("gt"),
                    F.round("gq", 2).alias("gq"), col("block_id").alias("phase_set"), F.lit(kind).alias("call_type"))


def _carriers(b: Blocks) -> DataFrame:
    return b.haplotypes.select("block_id", "haplotype_id", F.explode("allele_ids").alias("allele_id"))


def call_individual(reads: DataFrame, reference: DataFrame, o: Options = Options(), *, raw: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """Germline calls, each sample on its own."""
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o, sources), o)
    gts = G.genotypes(b.haplotypes, o.ploidy, limit=o.max_haplotypes)
    gts = _cut(gts)
    post = _cut(G.individual_posteriors(G.genotype_likelihoods(gts, b.likelihoods), _ln_prior(b, gts, o)))
    return _records(b, G.best_genotypes(post), G.allele_posteriors(post, _carriers(b)), o)


def call_population(reads: DataFrame, reference: DataFrame, o: Options = Options(), *, raw: bool = True) -> DataFrame:
    """Germline calls with haplotype frequencies shared by the samples (EM)."""
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o), o)
    post = _cut(G.population_em(b.likelihoods, b.haplotypes, ploidy=o.ploidy))
    return _records(b, G.best_genotypes(post), G.allele_posteriors(post, _carriers(b)), o)


def call_trio(reads: DataFrame, reference: DataFrame, mother: str, father: str, child: str, o: Options = Options(), *, raw: bool = True) -> DataFrame:
    """De novo and inherited calls of a child: the joint posterior of the three genotypes."""
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o), o)
    gts = G.genotypes(b.haplotypes, 2, limit=o.max_haplotypes)
    moves = T.transition_map(T.transitions(b.haplotypes, T.allele_costs(b.blocks, repeat_table(reference), snv_rate=o.denovo_prior, indel_rate=o.denovo_indel_prior)))
    joint = _cut(G.trio_posteriors(_cut(G.genotype_likelihoods(_cut(gts), b.likelihoods)), mother, father, child, top=o.max_genotype_combinations, transition=moves))
    post = joint.groupBy("block_id", F.lit(child).alias("sample"), col("c").alias("haplotype_ids")).agg(F.sum("posterior").alias("posterior"))
    denovo = joint.groupBy("block_id").agg(F.sum(F.when(col("is_denovo"), col("posterior")).otherwise(0.0)).alias("p_denovo"))
    calls = _records(b, G.best_genotypes(post), G.allele_posteriors(post, _carriers(b)), o)
    calls = calls.join(denovo.withColumnRenamed("block_id", "phase_set"), "phase_set")
    return calls.withColumn("call_type", F.when(N.probability_true_to_phred(col("p_denovo")) >= o.min_denovo_posterior, "denovo").otherwise("germline")).drop("p_denovo")


def call_mixture(reads: DataFrame, reference: DataFrame, o: Options = Options(), *, normal: str | None = None, raw: bool = True) -> DataFrame:
    """Alleles of mixed samples (polyclonal, tumour) by the mass of the haplotypes that carry them.

    With a ``normal`` sample, alleles it lacks are somatic.
    """
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o), o)
    weights = G.clone_mixtures(b.likelihoods, concentration=o.clone_concentration / 10)
    w = weights.join(_carriers(b), ["block_id", "haplotype_id"]).groupBy("block_id", "sample", "allele_id").agg(F.sum("weight").alias("frequency"))
    w = w.where(col("frequency") >= max(o.min_clone_frequency, 0.02))
    if normal is not None:
        has = w.where((col("sample") == normal) & (col("frequency") > 0.2)).select("block_id", "allele_id", F.lit(True).alias("in_normal"))
        w = w.join(has, ["block_id", "allele_id"], "left")
    kind = F.when(F.coalesce(col("in_normal"), F.lit(False)), "germline").otherwise("somatic") if normal is not None else F.lit("clone")
    variants = b.blocks.select("block_id", "contig", F.posexplode("variants").alias("allele_id", "v"))
    return w.join(variants, ["block_id", "allele_id"]).select("contig", "v.start_pos", "v.end_pos", "v.ref", "v.alt", "sample", F.round("frequency", 4).alias("frequency"),
                                                            col("block_id").alias("phase_set"), kind.alias("call_type"))


def call_cancer(reads: DataFrame, reference: DataFrame, o: Options = Options(), *, normal: str | None = None, raw: bool = True) -> DataFrame:
    """Germline, copy-number and somatic calls of tumour samples, with or without a normal one.

    A variant is somatic with the mass of somatic models whose further haplotype alone carries it, and germline with the mass of all
    models whose germline haplotypes do; ``call_type`` is the likelier.  ``p_cnv`` is the mass of copy-number models of its block.
    """
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o), o)
    gts = _cut(G.genotypes(b.haplotypes, o.ploidy, limit=o.max_haplotypes))
    germline = _ln_prior(b, gts, o).withColumnRenamed("ln_prior", "ln_joint")
    pooled = G.genotype_likelihoods(gts, b.likelihoods if normal is None else b.likelihoods.where(col("sample") == normal)).groupBy("block_id", "haplotype_ids").agg(F.sum("ln_likelihood").alias("_ln"))
    best = F.row_number().over(W.partitionBy("block_id").orderBy(F.desc(F.round(col("ln_joint") + col("_ln"), 9)), "haplotype_ids"))
    germline = _cut(germline.join(pooled, ["block_id", "haplotype_ids"]).withColumn("_k", best).where("_k <= 4").drop("_k", "_ln"))
    moves = T.transition_map(T.transitions(b.haplotypes, T.allele_costs(b.blocks, repeat_table(reference), snv_rate=o.somatic_prior, indel_rate=o.somatic_indel_prior)))
    more = germline.join(b.haplotypes.select("block_id", col("haplotype_id").alias("somatic_id")), "block_id").where(~F.array_contains("haplotype_ids", col("somatic_id"))).join(moves, "block_id")
    more = more.select("block_id", "haplotype_ids", "somatic_id", T.cancer_genotype_ln_prior(F.lit(0.0), col("haplotype_ids"), F.array("somatic_id"), col("transition")).alias("ln_p"))
    models = _cut(Mx.cancer_models(b.likelihoods, germline, normal, more, germline_concentration=o.tumour_germline_concentration, seeds=min(3, o.max_vb_seeds)))
    carriers = b.haplotypes.select("block_id", "haplotype_id", "allele_ids")
    own = models.withColumn("_n", F.monotonically_increasing_id())
    g = own.select("_n", "block_id", F.explode("haplotype_ids").alias("haplotype_id")).join(carriers, ["block_id", "haplotype_id"]).groupBy("_n").agg(F.array_distinct(F.flatten(F.collect_list("allele_ids"))).alias("_g"))
    y = own.join(g, "_n", "left").join(carriers.select("block_id", col("haplotype_id").cast("bigint").alias("somatic_id"), col("allele_ids").alias("_s")), ["block_id", "somatic_id"], "left")
    none = F.array().cast("array<int>")
    y = y.withColumn("_g", F.coalesce("_g", none)).withColumn("_s", F.array_except(F.coalesce("_s", none), F.coalesce("_g", none)))
    mass = y.select("block_id", "model", "posterior", "vaf", F.explode(F.concat(F.transform("_g", lambda a: F.struct(a.alias("allele_id"), F.lit(False).alias("som"))), F.transform("_s", lambda a: F.struct(a.alias("allele_id"), F.lit(True).alias("som"))))).alias("c"))
    mass = mass.groupBy("block_id", "c.allele_id").agg(F.sum(F.when(~col("c.som"), col("posterior")).otherwise(0.0)).alias("p_germline"), F.sum(F.when(col("c.som"), col("posterior")).otherwise(0.0)).alias("p_somatic"),
                                                      F.max(F.when(col("c.som"), col("vaf"))).alias("vaf"))
    cnv = models.groupBy("block_id").agg(F.sum(F.when(col("model") == "cnv", col("posterior")).otherwise(0.0)).alias("p_cnv"))
    variants = b.blocks.select("block_id", "contig", F.posexplode("variants").alias("allele_id", "v"))
    x = mass.where((col("p_germline") > 0.5) | (col("p_somatic") > o.min_somatic_posterior)).join(variants, ["block_id", "allele_id"]).join(cnv, "block_id")
    return x.select("contig", "v.start_pos", "v.end_pos", "v.ref", "v.alt", F.when(col("p_somatic") > col("p_germline"), "somatic").otherwise("germline").alias("call_type"),
                    F.round(N.probability_true_to_phred(F.greatest("p_germline", "p_somatic")), 2).alias("qual"), F.round(F.when(col("p_somatic") > col("p_germline"), col("vaf")), 4).alias("vaf"), F.round("p_cnv", 6).alias("p_cnv"), col("block_id").alias("phase_set"))


def call_cells(reads: DataFrame, reference: DataFrame, o: Options = Options(), *, raw: bool = True) -> DataFrame:
    """Calls of single cells, which share the genotypes of few groups: one row per variant and sample with its ``cell_group``."""
    x = _cut(preprocess(reads, o)) if raw else reads
    b = infer_blocks(x, reference, candidate_variants(x, reference, o), o)
    gts = _cut(G.genotypes(b.haplotypes, o.ploidy, limit=o.max_haplotypes))
    lik = G.genotype_likelihoods(gts, b.likelihoods).join(_ln_prior(b, gts, o), ["block_id", "haplotype_ids"])
    cells = _cut(Mx.cell_phylogeny(lik.select("block_id", "sample", "haplotype_ids", (col("ln_likelihood") + col("ln_prior")).alias("ln_likelihood")), max_groups=o.max_cell_groups, dropout=o.dropout))
    variants = b.blocks.select("block_id", "contig", F.posexplode("variants").alias("allele_id", "v"))
    haps = cells.select("block_id", "sample", "cell_group", F.posexplode("haplotype_ids").alias("i", "haplotype_id")).join(b.haplotypes.select("block_id", "haplotype_id", "allele_ids"), ["block_id", "haplotype_id"])
    haps = haps.groupBy("block_id", "sample", "cell_group").agg(F.array_sort(F.collect_list(F.struct("i", "allele_ids"))).alias("haps"))
    y = haps.join(variants, "block_id").withColumn("gt", F.transform("haps", lambda h: F.array_contains(h["allele_ids"], col("allele_id")).cast("int")))
    return y.where(F.exists("gt", lambda g: g > 0)).select("contig", "v.start_pos", "v.end_pos", "v.ref", "v.alt", "sample", "cell_group", "gt", col("block_id").alias("phase_set"))


def reference_calls(runs: DataFrame, calls: DataFrame, *, min_depth: int = 1) -> DataFrame:
    """Blocks without a call that are covered at least ``min_depth`` deep."""
    from ..operators.interval import subtract

    covered = runs.where(col("depth") >= min_depth)
    return subtract(covered, calls.select("contig", "start_pos", F.greatest(col("end_pos"), col("start_pos") + 1).alias("end_pos"))).withColumn("call_type", F.lit("reference"))
