"""Calls in, filtered calls out: the second entry point.  Records are those of :mod:`strandloom.sources.text_formats`."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators.reads import with_duplicate_groups
from ..sources.store import cut
from ..sources.text_formats import read_vcf, vcf_header, write_vcf
from . import filters as X
from . import measures as M
from .facets import sequence_support, with_phase_length, with_reference_context, with_repeat_context
from .haplotypes import repeat_table

col = F.col


def with_call_id(records: DataFrame) -> DataFrame:
    """Number records by what they are, so that the number is the same each time they are read; equal records share it."""
    return records.withColumn("call_id", F.xxhash64("contig", "start_pos", "ref", F.array_join("alt", ","), F.coalesce("id", F.lit("."))))


def call_table(records: DataFrame) -> DataFrame:
    """Calls of numbered records, with the INFO fields that measures read."""
    info = lambda k: F.get(F.try_element_at("info", F.lit(k)), F.lit(0)).try_cast("double")
    flag = lambda k: F.map_contains_key("info", F.lit(k))
    return records.select("call_id", "contig", "start_pos", "end_pos", "ref", col("alt").alias("alts"), "qual", info("PP").alias("pp"), info("PPP").alias("ppp"), info("MP").alias("mp"),
                          flag("SOMATIC").alias("is_somatic"), flag("DENOVO").alias("is_denovo"))


def genotype_table(records: DataFrame, ploidy: int = 2, child: str | None = None) -> DataFrame:
    """A row per record and sample with a genotype; missing alleles are left out."""
    fmt = lambda k: F.get(F.try_element_at(col("v.fmt"), F.lit(k)), F.lit(0))
    x = records.select("call_id", F.explode("samples").alias("sample", "v"))
    return x.select("call_id", "sample", F.filter("v.gt", lambda g: g.isNotNull()).alias("gt"), "v.phased", "v.phase_set", fmt("GQ").try_cast("double").cast("int").alias("gq"), fmt("MP").try_cast("double").alias("gt_mp"),
                    F.lit(ploidy).alias("ploidy"), (col("sample") == child if child else F.lit(False)).alias("is_child")).where(F.size("gt") > 0)


def measure(records: DataFrame, names: list[str], *, reads: DataFrame | None = None, raw_reads: DataFrame | None = None, reference: DataFrame | None = None, chunk: int = 1 << 16,
            ploidy: int = 2, child: str | None = None) -> DataFrame:
    """The named measures of numbered records; only the facets that they need are built."""
    calls, gts = call_table(records), genotype_table(records, ploidy, child)
    needed = {f for n in names if n in M.MEASURES for f in M.MEASURES[n].facets} | ({"support"} if any(n in M.ACROSS for n in names) else set())
    if {"GC", "STRL", "STRP"} & set(names):
        calls = with_repeat_context(with_reference_context(calls, reference, chunk=chunk), repeat_table(reference), gts)
    if "PLN" in names:
        gts = with_phase_length(gts, calls)
    support = ambiguous = None
    if needed & {"support", "duplicates", "concordance", "ambiguous"}:
        reads = with_duplicate_groups(reads)
        support, ambiguous = sequence_support(calls, reads)
    return M.evaluate(M.Facets(calls, gts, reads, reads if raw_reads is None else raw_reads, support, ambiguous), names)


def text_of(value: Column, is_array: bool, digits: int = 4) -> Column:
    """A measure's value as field texts; missing ones are dots, numbers have at most so many decimals."""
    one = lambda v: F.coalesce(F.regexp_replace(F.round(v.cast("double"), digits).cast("string"), r"\.0$", ""), F.lit("."))
    return F.when(value.isNull(), F.array(F.lit("."))).otherwise(F.transform(value, one)) if is_array else F.array(one(value))


def annotate(records: DataFrame, measured: DataFrame, names: list[str]) -> DataFrame:
    """Numbered records with measures as fields: those of a call in INFO, those of samples in FORMAT."""
    kinds = {f.name: isinstance(f.dataType, ArrayType) for f in measured.schema.fields}
    of_call = [n for n in names if n in M.MEASURES and M.MEASURES[n].level == "call"]
    of_sample = [n for n in names if n not in of_call]
    cells = lambda ns: F.map_from_arrays(F.array(*[F.lit(n) for n in ns]).cast("array<string>"), F.array(*[text_of(col(n), kinds[n]) for n in ns]).cast("array<array<string>>"))
    x = measured.select("call_id", "sample", cells(of_call).alias("_i"), cells(of_sample).alias("_f"))
    x = x.groupBy("call_id").agg(F.first("_i").alias("_i"), F.map_from_entries(F.collect_list(F.struct("sample", "_f"))).alias("_f"))  # as many as there are samples
    y = records.join(x, "call_id", "left")
    merged = lambda old, new: F.when(new.isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))
    y = y.withColumn("info", merged(col("info"), col("_i")))
    samples = F.transform_values("samples", lambda s, v: v.withField("fmt", merged(v["fmt"], F.try_element_at("_f", s))))
    return y.withColumn("samples", F.when(col("_f").isNull(), col("samples")).otherwise(samples)).drop("_i", "_f")


def classify(records: DataFrame, measured: DataFrame, soft: str, hard: str = "") -> DataFrame:
    """Numbered records with ``filter``: the reasons of all samples if each of them fails a soft condition.  Records that fail a
    hard condition in all their samples go; records without a measured sample pass."""
    kinds = {f.name: isinstance(f.dataType, ArrayType) for f in measured.schema.fields}
    fails = F.lit(False)
    for c in X.parse(hard):
        fails = fails | c.fails(col(c.measure), kinds[c.measure])
    x = measured.withColumn("filter", X.failing_keys(measured, X.parse(soft))).withColumn("_hard", fails)
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list("filter"))))
    merged = x.groupBy("call_id").agg(F.when(F.bool_and(F.size("filter") > 0), reasons).otherwise(F.array().cast("array<string>")).alias("_reasons"), F.bool_and("_hard").alias("_gone"))
    y = records.join(merged, "call_id", "left").where(~F.coalesce("_gone", F.lit(False)))
    return y.withColumn("filter", F.coalesce("_reasons", F.array().cast("array<string>"))).drop("_reasons", "_gone")


def passing(records: DataFrame) -> DataFrame:
    """The filter that refuses nothing: records with their filter cleared."""
    return records.withColumn("filter", F.array().cast("array<string>"))


def single_pass(records: DataFrame, soft: str, hard: str = "", annotations: list[str] = (), **inputs) -> DataFrame:
    """Measure, annotate and classify; records and measures are stages, since several joins read them and parsing is most of the work."""
    x = cut(with_call_id(records))
    names = list(dict.fromkeys([*X.required_measures(soft, hard), *annotations]))
    measured = cut(measure(x, names, **inputs))
    out = classify(x, measured, soft, hard)
    if annotations:
        out = annotate(out, measured, list(annotations))
    return out.drop("call_id")


def double_pass(records: DataFrame, names: list[str], score: Callable[[DataFrame], DataFrame], *, field: str = "RFGQ", **inputs) -> DataFrame:
    """First pass: features of all calls, kept as a stage.  ``score`` adds ``filter`` and the sample's quality ``field``.  Second
    pass: the records are read again and take both."""
    x = with_call_id(records)
    features = cut(X.features(measure(x, names, **inputs), names))
    scored = score(features)
    merged = X.merge_samples(scored, quality=field).select("call_id", F.when(col("is_filtered"), col("reasons")).otherwise(F.array().cast("array<string>")).alias("_reasons"), "joint_quality")
    out = x.join(merged, "call_id", "left").withColumn("filter", F.coalesce("_reasons", F.array().cast("array<string>")))
    quality = F.map_from_arrays(F.array(F.lit(field)), F.array(F.array(F.round("joint_quality", 2).cast("string"))))
    return out.withColumn("info", F.when(col("joint_quality").isNull(), col("info")).otherwise(F.map_concat(F.map_filter("info", lambda k, v: k != field), quality))).drop("_reasons", "joint_quality", "call_id")


def filter_vcf(spark: SparkSession, path: str, out: str, contig_sizes: Mapping[str, int], *, soft: str = X.GERMLINE, hard: str = "", annotations: list[str] = (), keep_unfiltered: bool = False, **inputs) -> None:
    """Read records, filter them anew and write them."""
    samples, _ = vcf_header(spark, path)
    done = single_pass(passing(read_vcf(spark, path)), soft, hard, annotations, **inputs)
    if not keep_unfiltered and hard:
        done = done.where(F.size("filter") >= 0)
    ids = dict.fromkeys(c.key for c in X.parse(soft))
    header = [f'##FILTER=<ID={i},Description="Fails a threshold">' for i in ids]
    for n in annotations:
        section, number = ("INFO", "1") if n in M.MEASURES and M.MEASURES[n].level == "call" else ("FORMAT", ".")
        header.append(f'##{section}=<ID={n},Number={number},Type=String,Description="{M.MEASURES[n].title if n in M.MEASURES else M.ACROSS[n][0]}">')
    write_vcf(done, out, samples, contig_sizes, header=header)
