"""Line deduplication over a suffix array of line ids; native DataFrame operations only.

Texts are sequences of line ids.  Prefix doubling ranks the blocks of 1, 2, 4, ...
lines that start at each line: a block of 2h lines is the pair of the ranks of its
halves, and sorted pairs get increasing ids from a range-partitioned sort.  A block
that occurs once is settled and leaves the sort, so that each level holds only
suffixes that still share their first 2^k lines with another, i.e. the
longest-common-prefix intervals of depth 2^k, each with its first occurrence.

For every suffix that is not the first of its deepest interval, the common prefix
with that interval's first suffix is measured by descending the levels.  Where a third
copy could share more lines, the longest prefix that has any earlier copy is found by
halving between 2^k and 2^(k+1) lines: a block of such a length is the pair of ranks of
its first and last 2^k lines, and has an earlier copy if the pair occurs before.  Such a
search is needed only where the 2^k lines that end behind the measured run have an earlier
copy themselves.  This is a maximal repeated run; if it has ``min_words`` words its lines
go from the later copy.  Runs with too few characters for so many words leave early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import heavy_lookup, materialize, with_lookup

#: A repeated run must have as many words.
MIN_WORDS = 50
#: Stands for a null doc_id in the order of documents.
NO_ID = -(1 << 63)
#: Columns that name a document: its id and a hash of its text.
DOC = ["d", "h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _doc_key(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h")]


def _ranked(groups: DataFrame, key: str) -> DataFrame:
    """Increasing ids ``r`` in the order of ``key``, by a range-partitioned sort."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("r", F.monotonically_increasing_id())


def _level(blocks: DataFrame, key: str, total: int) -> DataFrame:
    """Blocks that occur more than once, with rank ``r`` and first occurrence ``first``."""
    groups = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "ln")).alias("first")).where("n > 1")
    ranked = materialize(_ranked(groups, key), "ranks")
    out = heavy_lookup(blocks, ranked, key, "n", total)
    return materialize(out.select(*DOC, "ln", "size", "chars", "r", "first", "n"), "level")


def _refined(levels: list[DataFrame], later: DataFrame, runs: DataFrame) -> DataFrame | None:
    """Longest runs with any earlier copy, ``d, h, ln, n``, of suffixes whose run may pass those of ``runs``.

    A suffix of depth ``k`` is left out if its interval has two members (one earlier copy, measured
    already), if its 2^(k+1) - 1 lines or the end of its document lie within runs at or before it, or if
    the 2^k lines that end with the first one behind those runs have no earlier copy.
    """
    width = F.call_function("shiftleft", F.lit(1), F.col("k"))
    span = W.partitionBy(*DOC).orderBy("ln").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = runs.groupBy(*DOC, "ln").agg(F.max("n").alias("known"))
    open_ = (later.join(known, [*DOC, "ln"], "left").withColumn("covered", F.coalesce(F.max(F.col("ln") + F.col("known")).over(span), F.lit(0)))
             .where((F.col("k") > 0) & (F.col("copies") > 2) & (F.least(F.col("ln") + 2 * width - 1, F.col("size")) > F.col("covered")))
             .select(*DOC, "ln", "k", "r", width.alias("n"), (F.col("covered") + 1 - width).alias("at")))
    # the last 2^k lines of a longer run have an earlier copy too
    able = later.where("k > 0").select(*DOC, F.col("ln").alias("at"), F.col("k").alias("deep"))
    open_ = open_.join(able, [*DOC, "at"]).where("deep >= k").drop("at", "deep")
    open_ = materialize(open_, "open")
    if open_.isEmpty():
        return None
    groups = open_.select("k", "r").distinct()
    ranks = None
    for k, level in enumerate(levels[1:], 1):
        own = level.select(*DOC, "ln", F.lit(k).alias("k"), "r")
        ranks = own if ranks is None else ranks.unionByName(own)
    peers = materialize(ranks.join(groups, ["k", "r"], "left_semi").distinct(), "peers")
    ranks = materialize(ranks.join(peers.select(*DOC, "k").distinct(), [*DOC, "k"], "left_semi").distinct(), "ranks-of-peers")
    ahead = ranks.select(*DOC, "k", F.col("ln").alias("at"), F.col("r").alias("r2"))
    block = ["k", "r", "m", "r2"]
    for j in range(len(levels) - 2, -1, -1):
        tests = open_.where(F.col("k") > j).withColumn("m", F.col("n") + (1 << j))
        at = (F.col("ln") + F.col("m") - width).alias("at")
        blocks = (peers.join(tests.select("k", "r", "m").distinct(), ["k", "r"]).select(*DOC, "ln", "k", "r", "m", at)
                  .join(ahead, [*DOC, "k", "at"]).groupBy(*block).agg(F.min(F.struct(*DOC, "ln")).alias("first")))
        found = (tests.select("*", at).join(ahead, [*DOC, "k", "at"]).join(blocks, block)
                 .where(F.col("first") < F.struct(*DOC, "ln")).select(*DOC, "ln", F.lit(1 << j).alias("more")))
        open_ = materialize(open_.join(found, [*DOC, "ln"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
                            .drop("more"), "open")
    return open_.select(*DOC, "ln", "n")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 1) -> DataFrame:
    """Later copies of maximal repeated runs: ``d, h`` (document), ``ln`` (first line, from 0), ``n`` (lines).

    Runs of fewer characters than ``min_words`` words and the white space between them take are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = materialize(
        docs.select(*_doc_key(id_col, text_col), _lines(text).alias("lines"))
        .select(*DOC, F.size("lines").alias("size"), F.posexplode("lines").alias("ln", "line"))
        .select(*DOC, "ln", "size", F.length("line").alias("chars"), F.unhex(F.md5("line")).alias("key")), "lines")
    levels = [_level(lines, "key", lines.count())]
    while True:
        here, step = levels[-1], 1 << (len(levels) - 1)
        ahead = W.partitionBy(*DOC).orderBy("ln").rangeBetween(step, step)
        pairs = (here.withColumn("next", F.first(F.struct("r", "chars")).over(ahead)).where("next is not null")
                 .select(*DOC, "ln", "size", (F.col("chars") + 1 + F.col("next.chars")).alias("chars"), F.struct("r", F.col("next.r").alias("next")).alias("key")))
        pairs = materialize(pairs, "pairs")
        total = pairs.count()
        if total < 2:
            break
        deeper = _level(pairs, "key", total)
        if deeper.isEmpty():
            break
        levels.append(deeper)

    later = None
    for k, level in enumerate(levels):
        own = level.where(F.struct(*DOC, "ln") != F.col("first")).select(*DOC, "ln", F.struct(
            F.lit(k).alias("k"), "first", "r", F.col("n").alias("copies"), "size", "chars").alias("deep"))
        later = own if later is None else later.unionByName(own)
    later = materialize(later.groupBy(*DOC, "ln").agg(F.max("deep").alias("deep")).select(*DOC, "ln", "deep.*"), "later")
    before = F.lag(F.struct("ln", "first")).over(W.partitionBy(*DOC).orderBy("ln"))
    same = ((F.col("b.ln") == F.col("ln") - 1) & (F.col("b.first.d") == F.col("first.d")) & (F.col("b.first.h") == F.col("first.h"))
            & (F.col("b.first.ln") == F.col("first.ln") - 1))
    runs = (later.withColumn("b", before).where(~F.coalesce(same, F.lit(False))).select(*DOC, "ln", "k", "first", "chars")
            .withColumn("n", F.call_function("shiftleft", F.lit(1), F.col("k"))))
    runs = materialize(runs, "runs")
    for k in range(len(levels) - 2, -1, -1):
        level = levels[k].select(*DOC, "ln", "r", "chars")
        mine = level.select(F.col("d"), F.col("h"), F.col("ln").alias("at"), F.col("r").alias("r1"), F.col("chars").alias("more"))
        theirs = level.select(F.col("d").alias("fd"), F.col("h").alias("fh"), F.col("ln").alias("fat"), F.col("r").alias("r2"))
        open_ = (runs.where(F.col("k") > k).withColumn("at", F.col("ln") + F.col("n")).withColumn("fat", F.col("first.ln") + F.col("n"))
                 .withColumn("fd", F.col("first.d")).withColumn("fh", F.col("first.h")))
        grown = (open_.join(mine, [*DOC, "at"], "left").join(theirs, ["fd", "fh", "fat"], "left")
                 .withColumn("n", F.col("n") + F.when(F.col("r1") == F.col("r2"), 1 << k).otherwise(0))
                 .withColumn("chars", F.col("chars") + F.when(F.col("r1") == F.col("r2"), F.col("more") + 1).otherwise(0)))
        runs = materialize(grown.select(*runs.columns).unionByName(runs.where(F.col("k") <= k)), "runs")
    refined = _refined(levels, later, runs)
    runs = runs.where(F.col("chars") >= 2 * min_words - 1).select(*DOC, "ln", "n")
    return runs if refined is None else runs.unionByName(refined)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without later copies of repeated runs, plus
    ``n_lines``, ``n_removed`` and ``removed`` (line numbers from 0).

    The order of copies is that of (doc_id, line); the first one stays, also within a document.  Rows
    that repeat an id and its text are one document.  Lines are split at line feeds and compared exactly;
    a null text counts as empty (one empty line) and comes back empty; a null id is before all others.
    A document all of whose lines go keeps its row with an empty text.  Columns of the input named like
    an added one are replaced.  An empty table gives an empty result.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words=min_words)
    per_doc = materialize(runs.distinct().groupBy(*DOC).agg(F.collect_list(F.struct("ln", "n")).alias("_runs")), "runs-by-doc")
    # a document may have many runs, so the size of the lookup table counts them
    size = per_doc.agg(F.coalesce(F.sum(100 + 24 * F.size("_runs")), F.lit(0)).alias("bytes")).first()["bytes"]
    cols = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed", "removed")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), text.alias("_text"),
                         F.struct(*_doc_key(id_col, text_col)).alias("_key"))
    table = per_doc.select(F.struct(*DOC).alias("_key"), "_runs")
    x = with_lookup(packed, table, "_key", size, 1)
    long_runs = F.filter(F.col("_runs"), lambda r: _words(F.array_join(F.slice(F.col("_lines"), r["ln"] + 1, r["n"]), "\n")) >= min_words)
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.col("_long"), lambda r: F.sequence(r["ln"], r["ln"] + r["n"] - 1)))))
    x = (x.withColumn("_lines", _lines(F.col("_text")))
         .withColumn("_long", F.coalesce(long_runs, F.array().cast("array<struct<ln:int,n:int>>")))
         .withColumn("_gone", removed))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")),
                       lambda i: F.get(F.col("_lines"), i))
    return x.select("_row.*",
                    F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
                    F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"),
                    F.col("_gone").alias("removed"))
