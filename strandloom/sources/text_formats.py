"""FASTA, SAM, VCF, PED and ploidy texts as DataFrames, and the writers of SAM, VCF and CSV.

Files are read with Spark's text source, so that splits, compression codecs and stores are Spark's own; only FASTA, whose
sequences span lines, is read as whole files, one task each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C

col = F.col
CHUNK = 1 << 16


def read_fasta(spark: SparkSession, path: str, *, chunk: int = CHUNK, capitalise: bool = True, disambiguate: bool = False) -> DataFrame:
    """``contig, contig_order, chunk, chunk_start, seq``: sequences in pieces, the last one shorter."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for order, record in enumerate(r for r in bytes(content).decode().split(">") if r.strip()):
                    head, _, body = record.partition("\n")
                    seq = "".join(body.split())
                    name = head.split()[0]
                    rows += [(name, order, i // chunk, i, seq[i:i + chunk]) for i in range(0, len(seq), chunk)]
                yield pd.DataFrame(rows, columns=["contig", "contig_order", "chunk", "chunk_start", "seq"])

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        run, "contig string, contig_order int, chunk int, chunk_start bigint, seq string")
    from ..functions import sequences as S

    if capitalise:
        out = out.withColumn("seq", F.upper("seq"))
    if disambiguate:
        out = out.withColumn("seq", S.disambiguate(col("seq")))
    return out


def contigs(reference: DataFrame) -> DataFrame:
    return reference.groupBy("contig", "contig_order").agg(F.sum(F.length("seq")).cast("bigint").alias("size"))


def fetch_sequences(regions: DataFrame, reference: DataFrame, *, chunk: int = CHUNK, fill: bool = True, id_cols: list[str] = ("contig", "start_pos", "end_pos")) -> DataFrame:
    """``regions`` with ``ref_seq``: an equi-join on contig and chunk; positions past the contig's end are N (or an error)."""
    ids = list(dict.fromkeys([*id_cols, "contig", "start_pos", "end_pos"]))
    # the end is included, so that every region touches a chunk
    x = regions.select(*ids, F.explode(F.sequence(F.floor(col("start_pos") / chunk), F.floor(F.greatest(col("end_pos") - 1, col("start_pos")) / chunk))).alias("chunk"))
    # a reference is larger than its statistics say (sequences count as 20 bytes), and must not be broadcast by them
    x = x.join(reference.select("contig", "chunk", "chunk_start", "seq").hint("merge"), ["contig", "chunk"], "left")
    begin, end = F.greatest("start_pos", "chunk_start"), F.least(col("end_pos"), col("chunk_start") + F.length("seq"))
    piece = F.when(end > begin, F.substr("seq", (begin - col("chunk_start") + 1).cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))
    seqs = x.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))).alias("p"))
    out = F.array_join(F.transform("p", lambda p: p["s"]), "")
    n = (col("end_pos") - col("start_pos")).cast("int")
    short = F.length(out) < n
    out = F.when(short, F.rpad(out, n, F.lit("N")) if fill else F.raise_error(F.lit("region is outside of its contig"))).otherwise(out)
    return regions.join(seqs.select(*ids, out.alias("ref_seq")), ids)


# --- SAM ---

_FLAGS = {"multiple_segment_template": 1, "all_segments_aligned": 2, "unmapped": 4, "reverse": 16, "first_segment": 64, "last_segment": 128,
          "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text in the read schema.  The region of a read includes its soft clips.

    The sample is that of the read group in the header; tags are a map; SA tags become ``supp``.
    """
    lines = spark.read.text(path)
    groups = lines.where(col("value").startswith("@RG")).select(
        F.regexp_extract("value", r"\tID:([^\t]*)", 1).alias("read_group"), F.regexp_extract("value", r"\tSM:([^\t]*)", 1).alias("sample"))
    cells = F.split("value", r"\t")
    c = [F.get(cells, F.lit(i)) for i in range(11)]
    flag = c[1].cast("int")
    tags = F.map_from_entries(F.transform(F.filter(F.slice(cells, 12, F.size(cells)), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:.:")), lambda t: F.struct(
        F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6), F.length(t)).alias("v"))))
    x = lines.where(~col("value").startswith("@")).select(
        c[0].alias("name"), c[2].alias("contig"), (c[3].cast("bigint") - 1).alias("pos"), c[4].cast("smallint").alias("mq"), C.parse(c[5]).alias("cigar"),
        c[6].alias("rnext"), c[7].cast("bigint").alias("pnext"), c[8].cast("bigint").alias("tlen"), F.when(c[9] == "*", "").otherwise(c[9]).alias("seq"), c[10].alias("qual"),
        *[(flag.bitwiseAND(bit) != 0).alias(n) for n, bit in _FLAGS.items()], (flag.bitwiseAND(8) != 0).alias("mu"), (flag.bitwiseAND(32) != 0).alias("mr"), tags.alias("tags"))
    front, _ = C.soft_clip_sizes(col("cigar"))
    quals = F.when((col("qual") == "*") | (col("seq") == ""), F.array().cast("array<smallint>")).otherwise(
        F.transform(F.split("qual", ""), lambda q: (F.ascii(q) - 33).cast("smallint")))
    mate = F.when(col("multiple_segment_template") & (col("rnext") != "*"), F.struct(
        F.when(col("rnext") == "=", col("contig")).otherwise(col("rnext")).alias("contig"), (col("pnext") - 1).alias("begin"), col("tlen").alias("tlen"), col("mu").alias("unmapped"), col("mr").alias("reverse")))
    begin = F.greatest(col("pos") - front, F.lit(0))
    sa = F.transform(F.filter(F.split(F.coalesce(F.try_element_at("tags", F.lit("SA")), F.lit("")), ";"), lambda s: s != ""), _supplementary)
    x = x.select("name", F.try_element_at("tags", F.lit("RG")).alias("read_group"), "contig", begin.alias("start_pos"),
                 (begin + F.coalesce(C.reference_size(col("cigar")), F.length("seq"))).alias("end_pos"), "seq", quals.alias("quals"), "cigar", "mq",
                 F.try_element_at("tags", F.lit("BX")).alias("barcode"), *_FLAGS, mate.alias("mate"), "tags", sa.alias("supp"))
    return x.join(F.broadcast(groups), "read_group", "left")


def _supplementary(s: Column) -> Column:
    f = F.split(s, ",")
    begin = f[1].cast("bigint") - 1
    ops = C.parse(f[3])
    return F.struct(f[0].alias("contig"), begin.alias("start_pos"), (begin + C.reference_size(ops)).alias("end_pos"), f[3].alias("cigar"), (f[2] == "+").alias("forward"), f[4].cast("smallint").alias("mq"))


def sam_lines(reads: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Text lines of alignments (without header)."""
    flag = sum((F.when(col(n), bit).otherwise(0) for n, bit in _FLAGS.items()), F.lit(0))
    flag = flag + F.when(F.coalesce("mate.unmapped", F.lit(False)), 8).otherwise(0) + F.when(F.coalesce("mate.reverse", F.lit(False)), 32).otherwise(0)
    front, _ = C.soft_clip_sizes(col("cigar"))
    quals = F.when(F.size("quals") == 0, "*").otherwise(F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"]))
    mate = F.coalesce(F.when(col("mate.contig") == col("contig"), F.lit("=")).otherwise(col("mate.contig")), F.lit("*"))
    cells = ["name", flag.cast("string"), "contig", F.when(col("contig") == "*", "0").otherwise((col("start_pos") + front + 1).cast("string")), col("mq").cast("string"), F.coalesce(F.nullif(C.to_text(col("cigar")), F.lit("")), F.lit("*")), mate,
             F.coalesce(col("mate.begin") + 1, F.lit(0)).cast("string"), F.coalesce("mate.tlen", F.lit(0)).cast("string"), F.when(col("seq") == "", "*").otherwise(col("seq")), quals]
    return reads.select(*keep, F.concat_ws("\t", *cells, F.array_join(tags, "\t")).alias("_l")).select(*keep, F.regexp_replace("_l", r"\t$", "").alias("line"))


def write_sam(reads: DataFrame, path: str, contig_sizes: Mapping[str, int], *, header: list[str] = (), compression: str | None = "gzip") -> None:
    """Sorted text files of alignments, each with the template's ``header`` lines (read groups and the like) and the contigs."""
    order = F.create_map(*[v for i, k in enumerate(contig_sizes) for v in (F.lit(k), F.lit(i))])
    head = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{k}\tLN:{n}" for k, n in contig_sizes.items()], *header])
    x = sam_lines(reads.withColumn("_c", F.element_at(order, "contig")), keep=["_c", "start_pos", "name"])
    x = x.repartitionByRange("_c", "start_pos").sortWithinPartitions("_c", "start_pos", "name")
    _write_with_head(x.select(col("line").alias("value")), head, path, compression)


def _write_with_head(lines: DataFrame, head: str, path: str, compression: str | None) -> None:
    """Text files each of which begins with ``head``, so that each is complete."""
    def with_header(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fresh = True
        for b in batches:
            values = b.column(0).to_pylist()
            if fresh and values:
                values, fresh = [head, *values], False
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})

    writer = lines.mapInArrow(with_header, "value string").write
    (writer.option("compression", compression) if compression else writer).text(path)


# --- VCF ---

def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], dict[tuple[str, str], tuple[str, str]]]:
    """Sample names, and (section, id) -> (number, type).  Header lines only reach the driver."""
    import re

    lines = [r[0] for r in spark.read.text(path).where(col("value").startswith("#")).collect()]
    samples: list[str] = []
    fields: dict[tuple[str, str], tuple[str, str]] = {}
    for line in lines:
        if line.startswith("#CHROM"):
            samples = line.rstrip("\n").split("\t")[9:]
        elif m := re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)", line):
            fields[m[1], m[2]] = (m[3], m[4])
    return samples, fields


def read_vcf(spark: SparkSession, path: str, *, sites_only: bool = False, contig: str | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Records with zero-based regions: ``info`` as map of lists, ``samples`` as map of genotype and format fields.

    A region keeps the records that overlap it; lines of other contigs are refused before they are split.
    """
    samples, _ = vcf_header(spark, path)
    lines = spark.read.text(path)
    if contig is not None:
        lines = lines.where(col("value").startswith(contig + "\t"))
    out = parse_vcf(lines, samples, sites_only=sites_only)
    if end is not None:
        out = out.where(col("start_pos") < max(end, (begin or 0) + 1))
    return out if begin is None else out.where(F.greatest("end_pos", col("start_pos") + 1) > begin)


def parse_vcf(lines: DataFrame, samples: list[str], *, sites_only: bool = False) -> DataFrame:
    """Records of text lines (column ``value``); header lines and empty ones are left out."""
    cells = F.split("value", r"\t")
    c = [F.get(cells, F.lit(i)) for i in range(9)]
    missing = lambda x: F.when(x != ".", x)
    split_info = F.transform(F.filter(F.split(c[7], ";"), lambda s: (s != ".") & (s != "")), lambda s: F.struct(
        F.substring_index(s, "=", 1).alias("k"), F.when(s.contains("="), F.split(F.substr(s, F.instr(s, "=") + 1, F.length(s)), ",")).otherwise(F.array().cast("array<string>")).alias("v")))
    cols = [c[0].alias("contig"), (c[1].cast("bigint") - 1).alias("start_pos"), (c[1].cast("bigint") - 1 + F.length(c[3])).alias("end_pos"), missing(c[2]).alias("id"), c[3].alias("ref"),
            F.filter(F.split(c[4], ","), lambda a: a != ".").alias("alt"), missing(c[5]).try_cast("double").alias("qual"),
            F.filter(F.split(c[6], ";"), lambda f: ~f.isin("PASS", ".")).alias("filter"), F.map_from_entries(split_info).alias("info")]
    if samples and not sites_only:
        keys = F.split(c[8], ":")
        # one expression for all samples, however many there are
        entries = F.zip_with(F.array(*[F.lit(s) for s in samples]), F.slice(cells, 10, len(samples)), lambda s, v: F.struct(s.alias("k"), _genotype(keys, F.split(v, ":")).alias("v")))
        cols.append(F.map_from_entries(entries).alias("samples"))
    return lines.where(~col("value").startswith("#") & (F.trim("value") != "")).select(*cols)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times but that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _genotype(keys: Column, values: Column) -> Column:
    padded = F.transform(keys, lambda k, i: F.split(F.coalesce(F.get(values, i), F.lit(".")), ","))

    def fields(fmt: Column) -> Column:
        gt = F.coalesce(F.get(F.try_element_at(fmt, F.lit("GT")), F.lit(0)), F.lit(""))
        calls = F.transform(F.filter(F.split(gt, r"[/|]"), lambda g: g != ""), lambda g: g.try_cast("int"))
        phase = F.get(F.try_element_at(fmt, F.lit("PS")), F.lit(0)).try_cast("bigint")
        return F.struct(calls.alias("gt"), gt.contains("|").alias("phased"), phase.alias("phase_set"), F.map_filter(fmt, lambda k, v: k != "GT").alias("fmt"))

    return _let(F.map_from_arrays(keys, padded), fields)


def vcf_line(records: DataFrame, samples: list[str]) -> Column:
    """The text line of a record; the format keys are those that any sample has, GT first."""
    join = lambda xs: F.when(F.size(xs) == 0, ".").otherwise(F.array_join(xs, ","))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(F.size(e["value"]) == 0, e["key"]).otherwise(
        F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";")
    cells = [col("contig"), (col("start_pos") + 1).cast("string"), F.coalesce("id", F.lit(".")), col("ref"), join(col("alt")), F.coalesce(col("qual").cast("string"), F.lit(".")),
             F.when(F.size("filter") == 0, "PASS").otherwise(F.array_join("filter", ";")), F.when(info == "", ".").otherwise(info)]
    if samples and "samples" in records.columns:
        keys = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("samples"), lambda v: F.map_keys(v["fmt"])))))

        def cell(v: Column, ks: Column) -> Column:
            alleles = F.transform(v["gt"], lambda g: F.coalesce(g.cast("string"), F.lit(".")))
            gt = F.when(v["phased"], F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))
            return F.array_join(F.concat(F.array(gt), _format_values(ks, v["fmt"])), ":")

        names = F.array(*[F.lit(s) for s in samples])
        cells.append(_let(keys, lambda ks: F.concat_ws("\t", F.array_join(F.concat(F.array(F.lit("GT")), ks), ":"), F.array_join(F.transform(
            names, lambda s: cell(F.element_at(col("samples"), s), ks)), "\t"))))
    return F.concat_ws("\t", *cells)


def merge_records(tables: list[DataFrame], contig_order: Mapping[str, int]) -> DataFrame:
    """Records of several tables in one order (contig, position, alleles); of equal sites the one of the first table that has it, and there the least ``id``.

    The order is a range-partitioned sort: parts follow one another, and no part is a whole contig.
    """
    x = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        x = x.unionByName(t.withColumn("_t", F.lit(i)))
    own = [c for c in tables[0].columns if c not in ("contig", "start_pos", "ref", "alt")]
    ties = [c for c in ("id", "qual") if c in own]
    first = x.groupBy("contig", "start_pos", "ref", "alt").agg(F.min_by(F.struct(*own), F.struct("_t", *ties)).alias("_r")).select("contig", "start_pos", "ref", "alt", *[col(f"_r.{c}").alias(c) for c in own])
    order = F.element_at(F.create_map(*[v for k, i in contig_order.items() for v in (F.lit(k), F.lit(i))]), "contig")
    return first.orderBy(order, "start_pos", "ref", F.array_join("alt", ",")).select(*tables[0].columns)


def write_vcf(records: DataFrame, path: str, samples: list[str], contig_sizes: Mapping[str, int], *, header: list[str] = (), compression: str | None = "gzip") -> None:
    """Sorted text files of ``records`` (schema of :func:`read_vcf`): a range-partitioned sort by contig order and position.

    Every part begins with the header, so that each is a complete file.
    """
    order = F.create_map(*[x for i, k in enumerate(contig_sizes) for x in (F.lit(k), F.lit(i))])
    head = "\n".join(["##fileformat=VCFv4.3", *header, *[f"##contig=<ID={k},length={v}>" for k, v in contig_sizes.items()],
                      "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])])
    x = records.select(F.element_at(order, "contig").alias("_c"), "start_pos", "ref", vcf_line(records, samples).alias("value"))
    x = x.repartitionByRange("_c", "start_pos").sortWithinPartitions("_c", "start_pos", "ref")

    _write_with_head(x.select("value"), head, path, compression)


def _format_values(keys: Column, fmt: Column) -> Column:
    return F.transform(keys, lambda k: F.array_join(F.coalesce(F.try_element_at(fmt, k), F.array(F.lit("."))), ","))


def to_legacy_genotypes(records: DataFrame) -> DataFrame:
    """``*`` alternatives become the reference allele, as older readers expect."""
    star = F.array_position(F.transform("alt", lambda a: a == "*"), True)
    fix = lambda g: F.when((star > 0) & (g == star), F.lit(0)).otherwise(F.when((star > 0) & (g > star), g - 1).otherwise(g))
    samples = F.transform_values("samples", lambda k, v: v.withField("gt", F.transform(v["gt"], fix)))
    return records.withColumn("samples", samples).withColumn("alt", F.filter("alt", lambda a: a != "*"))


# --- small tables ---

def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """``member, sex, mother, father`` of a PED file; 0 is an unknown parent."""
    c = F.split(F.trim("value"), r"\s+")
    known = lambda x: F.when(x != "0", x)
    sex = F.when(c[4] == "1", "male").when(c[4] == "2", "female").otherwise("unknown")
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(c[1].alias("member"), sex.alias("sex"), known(c[3]).alias("mother"), known(c[2]).alias("father"))


def trios(pedigree: DataFrame) -> DataFrame:
    """Members both of whose parents are members too."""
    p = pedigree.alias("c").join(pedigree.select(col("member").alias("mother"), col("sex").alias("mother_sex")), "mother").join(
        pedigree.select(col("member").alias("father"), col("sex").alias("father_sex")), "father")
    return p.where("mother_sex <> 'male' and father_sex <> 'female'").select(col("member").alias("child"), "mother", "father")


def read_ploidies(spark: SparkSession, path: str) -> DataFrame:
    """``[sample:]contig=ploidy`` lines."""
    m = lambda i: F.regexp_extract(F.trim("value"), r"^(?:([^:=]+):)?([^:=]+)=(\d+)$", i)
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(
        F.nullif(m(1), F.lit("")).alias("sample"), m(2).alias("contig"), m(3).cast("int").alias("ploidy"))


def with_ploidy(df: DataFrame, ploidies: DataFrame, default: int = 2) -> DataFrame:
    """Add ``ploidy``: that of sample and contig, else of the contig, else the organism's."""
    own = ploidies.where("sample is not null").select("sample", "contig", col("ploidy").alias("_own"))
    any_ = ploidies.where("sample is null").select("contig", col("ploidy").alias("_any"))
    return df.join(F.broadcast(own), ["sample", "contig"], "left").join(F.broadcast(any_), "contig", "left").withColumn(
        "ploidy", F.coalesce("_own", "_any", F.lit(default))).drop("_own", "_any")


def read_config(text: str) -> dict[str, str]:
    """``key = value`` lines with # comments."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            k, _, v = line.partition("=")
            out[k.strip()] = v.strip()
    return out
