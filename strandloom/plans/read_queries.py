"""Queries over whole alignments: read filters, transforms, templates, copies, downsampling, base qualities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequences as S
from ..operators import interval as I
from ..operators import reads as P
from ..sources.derive import ALIGNED_SQL, aligned
from .interval_queries import overlap_sql
from .registry import register

col = F.col
PARAMS = {"has_sufficient_good_base_fraction": (20, 0.5), "has_sufficient_good_quality_bases": (20, 20), "is_short": (40,), "is_long": (10,), "has_tag": ("XA",), "not_has_tag": ("XA", "v1")}
_SUPP = "NOT coalesce({test} AND supp_mq >= 5, false)"
_TESTS = {
    "has_well_formed_cigar": "kind <> 2 AND front < len", "has_valid_base_qualities": "n_quals = len", "is_not_secondary_alignment": "NOT secondary",
    "is_not_supplementary_alignment": "NOT supplementary", "is_good_mapping_quality": "mq >= 5",
    "has_sufficient_good_base_fraction": "len(list_filter(quals, lambda q: q >= 20)) / greatest(len, 1) >= 0.5",
    "has_sufficient_good_quality_bases": "len(list_filter(quals, lambda q: q >= 20)) >= 20", "is_mapped": "NOT unmapped", "is_not_chimeric": "NOT has_mate",
    "is_next_segment_mapped": "NOT has_mate OR NOT mate_unmapped", "is_not_marked_duplicate": "NOT duplicate", "is_short": "len <= 40", "is_long": "len >= 10",
    "is_not_contaminated": "NOT has_mate OR abs(tlen) > end_pos - start_pos", "is_not_marked_qc_fail": "NOT qc_fail", "is_proper_template": "NOT has_mate OR proper",
    "is_local_template": "NOT has_mate OR mate_contig = contig", "no_unlocalized_supplementary_alignments": _SUPP.format(test="ends_with(supp_contig, '_random')"),
    "no_unplaced_supplementary_alignments": _SUPP.format(test="starts_with(supp_contig, 'chrU_')"), "no_decoy_supplementary_alignments": _SUPP.format(test="ends_with(supp_contig, '_decoy')"),
    "has_tag": "tag IS NOT NULL", "not_has_tag": "NOT coalesce(tag = 'v1', false)"}
_DEFAULT = " AND ".join(f"({_TESTS[n]})" for n in P.DEFAULT)

register("read_filters", lambda t: aligned(t).select("read_id", "start_pos", *[P.FILTERS[n](*PARAMS.get(n, ())).alias(n) for n in _TESTS]),
         f"WITH {ALIGNED_SQL} SELECT read_id, start_pos, " + ", ".join(f"{sql} AS {n}" for n, sql in _TESTS.items()) + " FROM al", ("aligned",))
register("default_read_filters", lambda t: P.apply_filters(aligned(t), params=PARAMS).select("read_id", "start_pos", "end_pos"),
         f"WITH {ALIGNED_SQL} SELECT read_id, start_pos, end_pos FROM al WHERE {_DEFAULT}", ("aligned",))
register("first_failed_filter", lambda t: P.failure_counts(aligned(t), params=PARAMS), f"WITH {ALIGNED_SQL}, f AS (SELECT CASE " + " ".join(
    f"WHEN NOT ({_TESTS[n]}) THEN '{n}'" for n in P.DEFAULT) + " END AS filter FROM al) SELECT filter, count(*) AS n FROM f WHERE filter IS NOT NULL GROUP BY filter", ("aligned",))

# --- masks: each as a digest of the qualities it leaves ---
_WINDOW = lambda: F.substring(S.reverse_complement(col("seq")), 1, 30)
_HEAD = lambda: F.substring("seq", 1, 30)
_MASKS = {
    "capped": lambda x: P.cap_base_qualities(x, 30), "overlapped": P.mask_overlapped_segment, "adapters": P.mask_adapters, "tail": lambda x: P.mask_tail(x, 5),
    "low_tail": lambda x: P.mask_low_quality_tails(x, 20), "clipped": P.mask_soft_clipped, "clipped_boundary": lambda x: P.mask_soft_clipped_boundary_bases(x, 2),
    "low_clipped": lambda x: P.mask_low_quality_soft_clipped_bases(x, 20), "low_boundary": lambda x: P.mask_low_quality_soft_clipped_boundary_bases(x, 2, 20),
    "low_average": lambda x: P.mask_low_average_quality_soft_clipped_tails(x, 20, 5), "inverted": lambda x: P.mask_inverted_soft_clipped_ends(x, _WINDOW(), 5),
    "shifted_heads": lambda x: P.mask_3prime_shifted_soft_clipped_heads(x, _HEAD(), 5)}


def _digest(c):
    return F.md5(F.array_join(c.cast("array<string>"), ","))


def masks(t):
    """All masks in one projection, each from the qualities as they are: a chain of columns would be planned for minutes."""
    x = aligned(t)
    digests = [_digest(P.masked_quality(fn)).alias(name) for name, fn in _MASKS.items()]
    return P.clear_annotations(x).select("read_id", "start_pos", S.capitalise(col("seq")).alias("seq"), F.size("tags").cast("long").alias("n_tags"), *digests)


_ENDS = "{n} > 0 AND CASE WHEN reverse THEN i <= {n} ELSE i > n_quals - {n} END"
_BOTH = "(front > 0 AND i <= front + {n}) OR (back > 0 AND i > n_quals - back - {n})"
_RC = "reverse(translate(substring(seq, {a}, {b}), 'ACGTacgt', 'TGCAtgca'))"
_MASK_SQL = {
    "overlapped": "i > n_quals - CASE WHEN NOT reverse AND has_mate AND mate_contig = contig AND NOT mate_unmapped THEN greatest(end_pos - mate_begin, 0) ELSE 0 END",
    "adapters": _ENDS.format(n="(CASE WHEN has_mate AND mate_contig = contig AND proper AND abs(tlen) < len THEN len - abs(tlen) ELSE 0 END)"), "tail": _ENDS.format(n="5"),
    "low_tail": "CASE WHEN reverse THEN i < coalesce(list_position(list_transform(quals, lambda x: x >= 20), true), n_quals + 1) ELSE i > n_quals + 1 - coalesce(list_position(list_transform(list_reverse(quals), lambda x: x >= 20), true), n_quals + 1) END",
    "clipped": _BOTH.format(n=0), "clipped_boundary": _BOTH.format(n=2), "low_clipped": f"q < 20 AND ({_BOTH.format(n=0)})", "low_boundary": f"q < 20 AND ({_BOTH.format(n=2)})",
    "low_average": "(front >= 5 AND list_avg(quals[1:front]) < 20 AND i <= front) OR (back >= 5 AND list_avg(quals[n_quals - back + 1:]) < 20 AND i > n_quals - back)",
    "inverted": f"(front >= 5 AND contains(w, {_RC.format(a='1', b='front')}) AND i <= front) OR (back >= 5 AND contains(w, {_RC.format(a='len - back + 1', b='back')}) AND i > n_quals - back)",
    "shifted_heads": "CASE WHEN reverse THEN back >= 5 AND contains(h, substring(seq, len - back + 1, back)) AND i > n_quals - back ELSE front >= 5 AND contains(h, substring(seq, 1, front)) AND i <= front END"}
register("read_masks", masks, f"""
WITH {ALIGNED_SQL}, m AS (SELECT *, substring({_RC.format(a='1', b='len')}, 1, 30) AS w, substring(seq, 1, 30) AS h FROM al)
SELECT read_id, start_pos, upper(seq) AS seq, CAST(0 AS BIGINT) AS n_tags, md5(array_to_string(list_transform(quals, lambda q: least(q, 30)), ',')) AS capped, """ + ", ".join(
    f"md5(array_to_string(list_transform(quals, lambda q, i: CASE WHEN {sql} THEN 0 ELSE q END), ',')) AS {n}" for n, sql in _MASK_SQL.items()) + " FROM m", ("aligned",))

# --- templates: reads of one name and sample ---


def template_masks(t):
    x = P.with_mate(aligned(t))
    raw = col("quals")
    x = P.mask_template_adapters(x.withColumn("_raw", raw)).withColumn("_a", _digest(raw)).withColumn("quals", col("_raw"))
    x = P.mask_strand_of_duplicated_bases(x).withColumn("_b", _digest(raw)).withColumn("quals", col("_raw"))
    x = P.mask_clipped_duplicated_bases(x).withColumn("_c", _digest(raw))
    return x.select("read_id", "start_pos", "end_pos", col("_a").alias("adapters"), col("_b").alias("duplicated"), col("_c").alias("clipped"))


_PAIR = "o.rid IS NOT NULL AND x.reverse <> o.reverse"
_OVER = "CASE WHEN x.reverse THEN greatest(o.start_pos - x.start_pos, 0) ELSE greatest(x.end_pos - o.end_pos, 0) END"
_THEIRS = "o.quals[CAST(x.start_pos + i - o.start_pos AS INT)]"
register("template_masks", template_masks, f"""
WITH {ALIGNED_SQL}, n AS (SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY sample, name) AS size FROM al)
SELECT x.read_id, x.start_pos, x.end_pos,
  md5(array_to_string(list_transform(x.quals, lambda q, i: CASE WHEN {_PAIR} AND CASE WHEN x.reverse THEN i <= {_OVER} ELSE i > x.n_quals - {_OVER} END THEN 0 ELSE q END), ',')) AS adapters,
  md5(array_to_string(list_transform(x.quals, lambda q, i: CASE WHEN {_PAIR} AND x.start_pos + i - 1 >= greatest(x.start_pos, o.start_pos) AND x.start_pos + i - 1 < least(x.end_pos, o.end_pos)
    AND coalesce(q < {_THEIRS} OR (q = {_THEIRS} AND ((x.start_pos + i - 1 - greatest(x.start_pos, o.start_pos)) % 2 = 0) = x.reverse), false) THEN 0 ELSE q END), ',')) AS duplicated,
  md5(array_to_string(list_transform(x.quals, lambda q, i: CASE WHEN o.rid IS NOT NULL AND x.start_pos + i - 1 >= o.start_pos AND x.start_pos + i - 1 < o.end_pos AND (i <= x.front OR i > x.n_quals - x.back) THEN 0 ELSE q END), ',')) AS clipped
FROM n x LEFT JOIN n o ON x.size = 2 AND o.sample = x.sample AND o.name = x.name AND o.rid <> x.rid""", ("aligned",))

# --- copies of reads, duplicates, fragments ---
_OP = "{{'size': greatest(least({at} + {n}, e) - greatest({at}, b), 0), 'flag': '{flag}'}}"
_TURN = "start_pos + front + m1"
register("copy_reads_to_region", lambda t: P.copy_to_region(aligned(t), col("start_pos") + 5, col("end_pos") - 7).select(
    "read_id", "start_pos", "end_pos", "seq", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"), C.to_text(col("cigar")).alias("cigar")), f"""
WITH {ALIGNED_SQL}, x AS (SELECT *, start_pos + 5 AS b, end_pos - 7 AS e FROM al WHERE end_pos - 7 >= start_pos + 5),
y AS (SELECT *, least(b - start_pos, front + m1) + CASE WHEN ins > 0 AND CASE WHEN b = e THEN {_TURN} < b ELSE {_TURN} <= b END THEN ins ELSE 0 END + least(greatest(b - ({_TURN}) - del, 0), m2 + back) AS o1,
  least(e - start_pos, front + m1) + CASE WHEN ins > 0 AND {_TURN} <= e THEN ins ELSE 0 END + least(greatest(e - ({_TURN}) - del, 0), m2 + back) AS o2 FROM x)
SELECT read_id, b AS start_pos, e AS end_pos, substring(seq, CAST(o1 + 1 AS INT), CAST(o2 - o1 AS INT)) AS seq, array_to_string(CASE WHEN o2 > o1 THEN quals[CAST(o1 + 1 AS INT):CAST(o2 AS INT)] ELSE [] END, ',') AS quals,
  array_to_string(list_transform(list_filter([{_OP.format(at='start_pos', n='front', flag='S')}, {_OP.format(at='start_pos + front', n='m1', flag='M')},
    {{'size': CASE WHEN ins > 0 AND ({_TURN} > b AND {_TURN} <= e OR b = e AND {_TURN} = b) THEN ins ELSE 0 END, 'flag': 'I'}}, {_OP.format(at=_TURN, n='del', flag='D')},
    {_OP.format(at=_TURN + ' + del', n='m2', flag='M')}, {_OP.format(at=_TURN + ' + del + m2', n='back', flag='S')}], lambda o: o.size > 0), lambda o: CAST(o.size AS VARCHAR) || o.flag), '') AS cigar FROM y""", ("aligned",))
_DUP_KEY = "sample, reverse, contig, CASE WHEN has_mate THEN concat_ws('|', mate_contig, mate_unmapped, mate_reverse, tlen) ELSE 'none' END"
for _policy, _place in (("relaxed", "start_pos, end_pos, cigar"), ("aggressive", "CASE WHEN reverse THEN end_pos ELSE start_pos END")):
    register(f"remove_duplicates_{_policy}", lambda t, p=_policy: P.remove_duplicates(aligned(t).withColumn("tie", F.concat_ws("/", col("read_id").cast("string"), "seq")), policy=p, id_cols=["read_id", "seq", "mq"]).select(
        "read_id", "start_pos", "end_pos", col("mq").cast("int").alias("mq")), f"""
WITH {ALIGNED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY {_DUP_KEY}, {_place} ORDER BY coalesce(list_sum(quals), 0) DESC, read_id, seq, mq) AS k FROM al WHERE start_pos < end_pos)
SELECT read_id, start_pos, end_pos, mq FROM k WHERE k = 1""", ("aligned",))
register("fragment_alignments", lambda t: P.fragment(aligned(t), 12).select("read_id", col("fragment").cast("long").alias("fragment"), "start_pos", "end_pos", "seq", F.size("quals").cast("long").alias("n_quals")), f"""
WITH {ALIGNED_SQL} SELECT read_id, i // 12 AS fragment, start_pos + i AS start_pos, start_pos + least(i + 12, len) AS end_pos, substring(seq, CAST(i AS INT) + 1, 12) AS seq, greatest(least(n_quals - i, 12), 0) AS n_quals
FROM (SELECT *, unnest(range(0, len, 12)) AS i FROM al)""", ("aligned",))


def downsampled(t):
    order = F.md5(F.concat_ws("/", "name", col("start_pos").cast("string"), col("end_pos").cast("string")))
    return P.downsample(t("reads").select("name", "sample", "contig", "start_pos", "end_pos"), trigger=4, target=2, order=order)


register("downsample", downsampled, f"""
WITH ev AS (SELECT sample, contig, start_pos AS p, 1 AS d FROM reads UNION ALL SELECT sample, contig, end_pos, -1 FROM reads),
st AS (SELECT sample, contig, p, sum(d) AS d FROM ev GROUP BY ALL),
run AS (SELECT sample, contig, p AS start_pos, lead(p) OVER w AS end_pos, sum(d) OVER w AS depth FROM st WINDOW w AS (PARTITION BY sample, contig ORDER BY p)),
hot AS (SELECT *, CASE WHEN start_pos > max(end_pos) OVER (PARTITION BY sample, contig ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM run WHERE depth > 2),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, contig ORDER BY start_pos) AS k FROM hot),
rg AS (SELECT sample, contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM isl GROUP BY sample, contig, k HAVING max(depth) > 4),
n AS (SELECT name, sample, contig, start_pos, end_pos, row_number() OVER (ORDER BY name, start_pos) AS rid, md5(name || '/' || CAST(start_pos AS VARCHAR) || '/' || CAST(end_pos AS VARCHAR)) AS o FROM reads),
m AS (SELECT n.*, EXISTS (SELECT 1 FROM rg WHERE rg.sample = n.sample AND {overlap_sql('rg', 'n')}) AS deep FROM n),
ps AS (SELECT DISTINCT sample, contig, unnest([start_pos, end_pos]) AS p FROM m WHERE deep),
rk AS (SELECT rid, row_number() OVER (PARTITION BY ps.sample, ps.contig, p ORDER BY o, name, rid) AS k FROM m JOIN ps ON ps.sample = m.sample AND ps.contig = m.contig AND m.start_pos <= p AND p < m.end_pos WHERE deep),
kp AS (SELECT DISTINCT rid FROM rk WHERE k <= 2)
SELECT name, sample, contig, start_pos, end_pos FROM m WHERE NOT deep OR rid IN (SELECT rid FROM kp)""", ("reads",))
register("base_quality_stats", lambda t: aligned(t).select("sample", "contig", F.explode("quals").alias("q")).groupBy("sample", "contig").agg(
    F.median("q").alias("median_bq"), F.round(F.sqrt(F.avg(col("q") * col("q"))), 6).alias("rms_bq"), F.count(F.lit(1)).alias("n")), f"""
WITH {ALIGNED_SQL} SELECT sample, contig, median(q) AS median_bq, round(sqrt(avg(q * q)), 6) AS rms_bq, count(*) AS n FROM (SELECT sample, contig, unnest(quals) AS q FROM al) GROUP BY sample, contig""", ("aligned",))
register("clipped_base_pairs", lambda t: (lambda x: x.groupBy("site_id").agg(F.sum("n").alias("base_pairs"), F.count_if(~col("reverse")).alias("n_forward"), F.sum(F.when(~col("reverse"), col("n")).otherwise(0)).alias("forward_base_pairs")))(
    I.interval_join(t("sites").withColumn("end_pos", col("end_pos") + 10), aligned(t)).select("l.site_id", "r.reverse", C.section(col("r.cigar"), col("r.start_pos"), col("l.start_pos"), col("l.end_pos"))["size"].alias("n"))), f"""
WITH {ALIGNED_SQL}, s AS (SELECT site_id, contig, start_pos, end_pos + 10 AS end_pos FROM sites), j AS (SELECT s.site_id, s.start_pos AS b, s.end_pos AS e, a.* FROM s JOIN al a ON {overlap_sql('s', 'a')}),
n AS (SELECT site_id, reverse, greatest(least(greatest(e - start_pos, 0), front + m1) + CASE WHEN ins > 0 AND {_TURN} <= e THEN ins ELSE 0 END + least(greatest(e - ({_TURN}) - del, 0), m2 + back)
  - least(greatest(b - start_pos, 0), front + m1) - CASE WHEN ins > 0 AND {_TURN} <= b THEN ins ELSE 0 END - least(greatest(b - ({_TURN}) - del, 0), m2 + back), 0) AS n FROM j)
SELECT site_id, CAST(sum(n) AS BIGINT) AS base_pairs, count(*) FILTER (WHERE NOT reverse) AS n_forward, CAST(coalesce(sum(n) FILTER (WHERE NOT reverse), 0) AS BIGINT) AS forward_base_pairs FROM n GROUP BY site_id""", ("aligned", "sites"))
register("cigar_functions", lambda t: aligned(t).select(
    "read_id", "start_pos", C.to_text(col("cigar")).alias("cigar"), C.to_text(C.parse(C.to_text(col("cigar")))).alias("parsed"), C.reference_size(col("cigar")).cast("long").alias("reference_size"),
    C.sequence_size(col("cigar")).cast("long").alias("sequence_size"), C.sum_matches(col("cigar")).cast("long").alias("matches"), C.sum_indel_sizes(col("cigar")).cast("long").alias("indels"),
    C.max_indel_size(col("cigar")).cast("long").alias("max_indel"), C.is_minimal(col("cigar")).alias("minimal"), C.to_text(C.collapse_matches(col("cigar"))).alias("collapsed"),
    F.array_join(C.decompose(col("cigar")), "").alias("flags"), C.operation_at(col("cigar"), F.lit(12))["flag"].alias("op12")), f"""
WITH {ALIGNED_SQL}, c AS (SELECT *, array_to_string(list_transform(cigar, lambda o: CAST(o.size AS VARCHAR) || o.flag), '') AS txt, array_to_string(list_transform(cigar, lambda o: repeat(o.flag, o.size)), '') AS flags FROM al)
SELECT read_id, start_pos, txt AS cigar, txt AS parsed, end_pos - start_pos AS reference_size, CAST(len AS BIGINT) AS sequence_size, CAST(m1 + m2 AS BIGINT) AS matches, CAST(ins + del AS BIGINT) AS indels, CAST(greatest(ins, del) AS BIGINT) AS max_indel, kind <> 2 AS minimal,
  CASE WHEN kind = 2 THEN CASE WHEN front > 0 THEN CAST(front AS VARCHAR) || 'S' ELSE '' END || CAST(m1 + m2 AS VARCHAR) || 'M' || CASE WHEN back > 0 THEN CAST(back AS VARCHAR) || 'S' ELSE '' END ELSE txt END AS collapsed,
  flags, CASE WHEN len > 12 THEN substring(replace(flags, 'D', ''), 13, 1) END AS op12 FROM c""", ("aligned",))
