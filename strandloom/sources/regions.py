"""Region texts and region files."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REGION = re.compile(r"^(?P<contig>.+?)(?::(?P<begin>[0-9,]+)(?P<dash>-)?(?P<end>[0-9,]+)?)?$")


class BadRegion(ValueError):
    pass


def parse_region(text: str, contig_sizes: Mapping[str, int]) -> tuple[str, int, int]:
    """``contig``, ``contig:pos``, ``contig:begin-`` or ``contig:begin-end``; commas are dropped, ends are cut at the contig's."""
    text = text.strip()
    if text in contig_sizes:
        return text, 0, contig_sizes[text]
    contig, sep, span = text.rpartition(":")
    if not sep:
        raise BadRegion(f"no such contig: {text!r}")
    if contig not in contig_sizes:
        raise BadRegion(f"no such contig: {contig!r}")
    m = re.fullmatch(r"([0-9][0-9,]*)(?:(-)([0-9][0-9,]*)?)?", span)
    if not m:
        raise BadRegion(f"not a region: {text!r}")
    size = contig_sizes[contig]
    begin = int(m[1].replace(",", ""))
    end = begin + 1 if not m[2] else int(m[3].replace(",", "")) if m[3] else size
    if end < begin:
        raise BadRegion(f"region ends before it begins: {text!r}")
    return contig, min(begin, size), min(end, size)


def parse_regions(text: Column, size: Column) -> Column:
    """Column form: ``struct(contig, start_pos, end_pos)`` given the contig's size; null for a malformed text."""
    clean = F.trim(text)
    contig = F.regexp_extract(clean, r"^(.*?)(?::[0-9][0-9,]*(?:-(?:[0-9][0-9,]*)?)?)?$", 1)
    span = F.regexp_extract(clean, r":([0-9][0-9,]*(?:-(?:[0-9][0-9,]*)?)?)$", 1)
    number = lambda i: F.regexp_replace(F.regexp_extract(span, r"^([0-9,]+)(-?)([0-9,]*)$", i), ",", "").try_cast("bigint")
    begin = F.coalesce(number(1), F.lit(0))
    end = F.when(span == "", size).when(F.regexp_extract(span, r"^([0-9,]+)(-?)", 2) == "", begin + 1).otherwise(F.coalesce(number(3), size))
    return F.when((contig != "") & (end >= begin), F.struct(contig.alias("contig"), F.least(begin, size).alias("start_pos"), F.least(end, size).alias("end_pos")))


def read_region_file(spark: SparkSession, path: str, contig_sizes: Mapping[str, int], *, one_based: bool = False, strict: bool = True) -> DataFrame:
    """One region per line; lines of a BED file (tabs) are zero-based, text regions may be one-based.

    A malformed line is an error, or skipped if not ``strict``.
    """
    if not contig_sizes:
        raise BadRegion("no contigs")
    sizes = F.create_map(*[x for k, v in contig_sizes.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    lines = spark.read.text(path).where("trim(value) <> '' and value not rlike '^(#|track|browser)'")
    cells = F.split("value", r"\t")
    bed = F.size(cells) > 1
    name = F.when(bed, cells[0]).otherwise(F.coalesce(F.when(F.try_element_at(sizes, F.trim("value")).isNotNull(), F.trim("value")), F.regexp_extract(F.trim("value"), r"^(.*):[^:]*$", 1)))
    size = F.try_element_at(sizes, name)
    row = F.struct(name.alias("contig"), F.least(cells[1].try_cast("bigint"), size).alias("start_pos"),
                   F.least(F.coalesce(F.get(cells, F.lit(2)).try_cast("bigint"), size), size).alias("end_pos"))
    own = parse_regions(F.col("value"), size)
    whole = F.trim("value") == name
    own = F.when(whole, F.struct(name.alias("contig"), F.lit(0).cast("bigint").alias("start_pos"), size.alias("end_pos"))).otherwise(own)
    if one_based:
        own = F.when(whole, own).otherwise(F.struct(own["contig"].alias("contig"), (own["start_pos"] - 1).alias("start_pos"), (own["end_pos"] - 1).alias("end_pos")))
    region = F.when(bed, row).otherwise(own)
    good = size.isNotNull() & region.isNotNull() & (region["contig"] == name) & region["start_pos"].isNotNull() & (region["end_pos"] >= region["start_pos"])
    if strict:
        region = F.when(F.coalesce(good, F.lit(False)), region).otherwise(F.raise_error(F.concat(F.lit("malformed region: "), F.col("value"))))
        return lines.select(region.alias("r")).select("r.*")
    return lines.where(F.coalesce(good, F.lit(False))).select(region.alias("r")).select("r.*")


def contig_range(first: str, last: str, order: list[str]) -> list[str]:
    """Contigs from ``first`` to ``last`` in the reference's order."""
    i, j = order.index(first), order.index(last)
    if j < i:
        raise BadRegion(f"{last} comes before {first}")
    return order[i:j + 1]
