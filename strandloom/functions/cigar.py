"""Cigar strings as arrays of ``struct<size:int, flag:string>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "MIDNSHP=X"
#: Operations along which the reference position moves; a read's region includes its soft clips.
ADVANCES_REFERENCE = "MDNSX="
ADVANCES_SEQUENCE = "MINSPX="
MATCHES, NON_MATCHES, CLIPS, INDELS = "M=", "XID", "SH", "ID"


def parse(text: Column) -> Column:
    """Operations of a cigar text; null if it is not one (``*`` included)."""
    ops = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(
        F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("size"), F.substr(x, F.length(x), F.lit(1)).alias("flag")))
    return F.when(text.rlike(r"^([0-9]+[MIDNSHP=X])+$"), ops)


def to_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["size"].cast("string"), o["flag"])), "")


def _in(o: Column, flags: str) -> Column:
    return o["flag"].isin(list(flags))


def _sum(ops: Column, flags: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(_in(o, flags), o["size"]).otherwise(0))


def is_valid(ops: Column) -> Column:
    """Not empty, and every operation known and of positive size."""
    return F.coalesce((F.size(ops) > 0) & F.forall(ops, lambda o: _in(o, FLAGS) & (o["size"] > 0)), F.lit(False))


def is_minimal(ops: Column) -> Column:
    """No two neighbours with the same flag."""
    pairs = F.zip_with(F.slice(ops, 1, F.greatest(F.size(ops) - 1, F.lit(0))), F.slice(ops, 2, F.size(ops)), lambda a, b: a["flag"] != b["flag"])
    return F.forall(pairs, lambda x: F.coalesce(x, F.lit(True)))


def sum_matches(ops: Column) -> Column:
    return _sum(ops, MATCHES)


def sum_non_matches(ops: Column) -> Column:
    return _sum(ops, NON_MATCHES)


def reference_size(ops: Column) -> Column:
    return _sum(ops, ADVANCES_REFERENCE)


def sequence_size(ops: Column) -> Column:
    return _sum(ops, ADVANCES_SEQUENCE)


def sum_indel_sizes(ops: Column) -> Column:
    return _sum(ops, INDELS)


def max_indel_size(ops: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda o: _in(o, INDELS)), lambda o: o["size"])), F.lit(0))


def has_indel(ops: Column) -> Column:
    return F.exists(ops, lambda o: _in(o, INDELS))


def soft_clip_sizes(ops: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the front and at the back, behind hard clips if there are any."""
    soft = F.filter(ops, lambda o: o["flag"] != "H")
    first, last = F.get(soft, F.lit(0)), F.get(soft, F.size(soft) - 1)
    front = F.when(first["flag"] == "S", first["size"]).otherwise(0)
    back = F.when((F.size(soft) > 1) & (last["flag"] == "S"), last["size"]).otherwise(0)
    return F.coalesce(front, F.lit(0)), F.coalesce(back, F.lit(0))


def is_soft_clipped(ops: Column) -> Column:
    return F.exists(ops, lambda o: o["flag"] == "S")


def decompose(ops: Column) -> Column:
    """One flag per base or gap position."""
    return F.flatten(F.transform(ops, lambda o: F.array_repeat(o["flag"], o["size"])))


def collapse_matches(ops: Column) -> Column:
    """``=`` and ``X`` become ``M``, and neighbours with the same flag join."""
    def step(acc: Column, o: Column) -> Column:
        flag = F.when(o["flag"].isin("=", "X"), F.lit("M")).otherwise(o["flag"])
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(F.struct((last["size"] + o["size"]).alias("size"), flag.alias("flag"))))
        return F.when(last["flag"] == flag, joined).otherwise(F.concat(acc, F.array(F.struct(o["size"].alias("size"), flag.alias("flag")))))

    return F.aggregate(ops, F.array().cast("array<struct<size:int,flag:string>>"), step)


def walk(ops: Column, begin: Column) -> Column:
    """Operations with the reference position ``at`` and the sequence offset ``off`` where each starts."""
    def step(acc: Column, o: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(o["size"].alias("size"), o["flag"].alias("flag"), acc["at"].alias("at"), acc["off"].alias("off")))).alias("out"),
            (acc["at"] + F.when(_in(o, ADVANCES_REFERENCE), o["size"]).otherwise(0)).alias("at"),
            (acc["off"] + F.when(_in(o, ADVANCES_SEQUENCE), o["size"]).otherwise(0)).alias("off"))

    zero = F.struct(F.array().cast("array<struct<size:int,flag:string,at:bigint,off:int>>").alias("out"), begin.cast("bigint").alias("at"), F.lit(0).alias("off"))
    return F.aggregate(ops, zero, step)["out"]


def is_gapless(ops: Column) -> Column:
    """Whether each base of the read stands on a reference position of its own."""
    return F.forall(ops, lambda o: o["flag"].isin("M", "=", "X", "S"))


def section(ops: Column, begin: Column, start: Column, end: Column, *, gapless: Column | None = None, stop: Column | None = None) -> Column:
    """``struct(off, size)``: the bases of a read from ``begin`` that lie on [start, end) of the reference.

    Where ``gapless`` (see :func:`is_gapless`, worked out once a read) holds, the place is plain arithmetic up to the read's end ``stop``.

    An insertion belongs to the base in front of it; on an empty region it is all there is.  Deleted positions
    have no bases.  Positions outside of the read are left out.
    """
    def before(pos: Column, inserted: Callable[[Column], Column]) -> Column:
        def step(acc: Column, o: Column) -> Column:
            both, ins = o["flag"].isin("M", "=", "X", "S"), o["flag"] == "I"
            n = F.when(both, F.least(F.greatest(pos - acc["at"], F.lit(0)), o["size"])).when(ins & inserted(acc["at"]), o["size"]).otherwise(0)
            return F.struct((acc["at"] + F.when(both | o["flag"].isin("D", "N"), o["size"]).otherwise(0)).cast("bigint").alias("at"), (acc["n"] + n).cast("int").alias("n"))

        return F.aggregate(ops, F.struct(begin.cast("bigint").alias("at"), F.lit(0).alias("n")), step)["n"]

    empty = start == end
    off = before(start, lambda at: F.when(empty, at < start).otherwise(at <= start))
    upto = before(end, lambda at: at <= end)
    if gapless is not None:
        plain = lambda pos: F.least(F.greatest(pos - begin, F.lit(0)), stop - begin).cast("int")
        known = F.coalesce(gapless, F.lit(False))
        off, upto = F.when(known, plain(start)).otherwise(off), F.when(known, plain(end)).otherwise(upto)
    return F.struct(off.alias("off"), F.greatest(upto - off, F.lit(0)).alias("size"))


def subregion(ops: Column, begin: Column, start: Column, end: Column) -> Column:
    """The operations on [start, end) of a read from ``begin``; insertions as in :func:`section`."""
    empty = start == end

    def cut(o: Column) -> Column:
        ref = o["flag"].isin("M", "=", "X", "S", "D", "N")
        n = F.when(ref, F.greatest(F.least(o["at"] + o["size"], end) - F.greatest(o["at"], start), F.lit(0)))
        inside = F.when(empty, o["at"] == start).otherwise((o["at"] > start) & (o["at"] <= end))
        return F.struct(F.coalesce(n, F.when(inside & (o["flag"] == "I"), o["size"]), F.lit(0)).cast("int").alias("size"), o["flag"].alias("flag"))

    return F.filter(F.transform(walk(ops, begin), cut), lambda o: o["size"] > 0)


def operation_at(ops: Column, place: Column) -> Column:
    """The operation that holds the base at ``place`` (from 0) of the sequence; null past its end."""
    at = F.transform(walk(ops, F.lit(0)), lambda o: F.struct(o["off"].alias("off"), F.struct(o["size"], o["flag"]).alias("op")))
    hits = F.filter(at, lambda o: (o["off"] <= place) & (place < o["off"] + o["op"]["size"]) & _in(o["op"], ADVANCES_SEQUENCE))
    return F.get(hits, F.lit(0))["op"]
