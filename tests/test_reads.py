"""Read filters, masks, duplicates, fragments and downsampling on literal reads."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.operators import reads as P

BASE = dict(name="a", sample="s", read_group="g", contig="1", start_pos=10, end_pos=20, seq="ACGTACGTAC", quals=[30] * 10, cigar=[(10, "M")], mq=60, barcode=None,
            multiple_segment_template=False, all_segments_aligned=False, unmapped=False, reverse=False, secondary=False, qc_fail=False, duplicate=False,
            supplementary=False, first_segment=False, last_segment=False, mate=None, tags={}, supp=[])


def frame(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **r}.values()) for r in rows], P.READ_SCHEMA)


def quals(df):
    return [list(r.quals) for r in df.orderBy("start_pos", "name").collect()]


@pytest.mark.parametrize("name, args, change", [
    ("has_well_formed_cigar", (), {"cigar": [(10, "S")]}), ("has_well_formed_cigar", (), {"cigar": [(5, "M"), (5, "M")]}), ("has_valid_base_qualities", (), {"quals": [1]}),
    ("is_not_secondary_alignment", (), {"secondary": True}), ("is_not_supplementary_alignment", (), {"supplementary": True}), ("is_good_mapping_quality", (61,), {}),
    ("has_sufficient_good_base_fraction", (40, 0.1), {}), ("has_sufficient_good_quality_bases", (20, 11), {}), ("is_mapped", (), {"unmapped": True}),
    ("is_not_chimeric", (), {"mate": ("1", 50, 60, False, True)}), ("is_next_segment_mapped", (), {"mate": ("1", 50, 60, True, True)}),
    ("is_not_marked_duplicate", (), {"duplicate": True}), ("is_short", (9,), {}), ("is_long", (11,), {}), ("is_not_contaminated", (), {"mate": ("1", 10, 8, False, True)}),
    ("is_not_marked_qc_fail", (), {"qc_fail": True}), ("is_proper_template", (), {"mate": ("1", 50, 60, False, True)}), ("is_local_template", (), {"mate": ("2", 50, 60, False, True)}),
    ("no_decoy_supplementary_alignments", (5,), {"supp": [("x_decoy", 1, 2, "1M", True, 9)]}), ("no_unplaced_supplementary_alignments", (5,), {"supp": [("chrU_1", 1, 2, "1M", True, 9)]}),
    ("no_unlocalized_supplementary_alignments", (5,), {"supp": [("c_random", 1, 2, "1M", True, 9)]}), ("has_tag", ("XX",), {}), ("not_has_tag", ("XX", "1"), {"tags": {"XX": "1"}})])
def test_filters_reject(spark, name, args, change):
    assert frame(spark, change).where(P.FILTERS[name](*args)).count() == 0


def test_default_filters_pass_a_good_read(spark):
    good = {"quals": [30] * 20, "seq": "A" * 20, "cigar": [(20, "M")], "end_pos": 30}
    assert P.apply_filters(frame(spark, good)).count() == 1
    bad = {**good, "duplicate": True}
    assert P.failure_counts(frame(spark, good, bad)).collect() == [Row(filter="is_not_marked_duplicate", n=1)]


def test_masks(spark):
    clip = {"cigar": [(2, "S"), (5, "M"), (3, "S")], "quals": [2, 9, 30, 30, 30, 30, 30, 4, 4, 4]}
    assert quals(P.mask_tail(frame(spark, {}), 3)) == [[30] * 7 + [0] * 3]
    assert quals(P.mask_tail(frame(spark, {"reverse": True}), 3)) == [[0] * 3 + [30] * 7]
    assert quals(P.mask_soft_clipped(frame(spark, clip))) == [[0, 0, 30, 30, 30, 30, 30, 0, 0, 0]]
    assert quals(P.mask_soft_clipped_boundary_bases(frame(spark, clip), 1)) == [[0, 0, 0, 30, 30, 30, 0, 0, 0, 0]]
    assert quals(P.mask_low_quality_soft_clipped_bases(frame(spark, clip), 5)) == [[0, 9, 30, 30, 30, 30, 30, 0, 0, 0]]
    assert quals(P.mask_low_average_quality_soft_clipped_tails(frame(spark, clip), 5, 3)) == [[2, 9, 30, 30, 30, 30, 30, 0, 0, 0]]
    assert quals(P.mask_low_quality_tails(frame(spark, {"quals": [30] * 7 + [5, 3, 2]}), 10)) == [[30] * 7 + [0] * 3]
    assert quals(P.mask_overlapped_segment(frame(spark, {"mate": ("1", 16, 14, False, True)}))) == [[30] * 6 + [0] * 4]
    assert quals(P.mask_adapters(frame(spark, {"mate": ("1", 10, 7, False, True), "all_segments_aligned": True}))) == [[30] * 7 + [0] * 3]
    assert quals(P.cap_base_qualities(frame(spark, {}), 20)) == [[20] * 10]


def test_template_masks(spark):
    pair = [{"reverse": False}, {"reverse": True, "start_pos": 14, "end_pos": 24, "quals": [20] * 10}]
    assert quals(P.mask_strand_of_duplicated_bases(frame(spark, *pair))) == [[30] * 10, [0] * 6 + [20] * 4]
    inside = [{"reverse": False}, {"reverse": True, "start_pos": 8, "end_pos": 18}]
    assert quals(P.mask_template_adapters(frame(spark, *inside))) == [[0, 0] + [30] * 8, [30] * 8 + [0, 0]]


def test_duplicates(spark):
    rows = [{"name": "x"}, {"name": "y", "quals": [31] * 10}, {"name": "z", "cigar": [(4, "M"), (6, "S")]}, {"name": "w", "reverse": True}]
    assert {r.name for r in P.remove_duplicates(frame(spark, *rows)).collect()} == {"y", "z", "w"}
    assert {r.name for r in P.remove_duplicates(frame(spark, *rows), policy="aggressive").collect()} == {"y", "w"}


def test_fragments(spark):
    got = [(r.start_pos, r.end_pos, r.seq, len(r.quals)) for r in P.fragment(frame(spark, {}), 4).orderBy("fragment").collect()]
    assert got == [(10, 14, "ACGT", 4), (14, 18, "ACGT", 4), (18, 20, "AC", 2)]


def test_downsampling_keeps_the_target_depth(spark):
    rows = [{"name": f"r{i}", "start_pos": 100 + i % 7, "end_pos": 120 + i % 5} for i in range(60)] + [{"name": "far", "start_pos": 500, "end_pos": 510}]
    kept = P.downsample(frame(spark, *rows), trigger=30, target=10).collect()
    assert any(r.name == "far" for r in kept) and len(kept) < 50
    for pos in range(100, 125):
        before = sum(r["start_pos"] <= pos < r["end_pos"] for r in rows[:-1])
        after = sum(r.start_pos <= pos < r.end_pos for r in kept)
        assert after >= min(before, 10)


def test_cigars(spark):
    df = spark.createDataFrame([("3S5M2I4D6M1H",)], "c string").withColumn("o", C.parse(F.col("c")))
    r = df.select(C.to_text(F.col("o")).alias("t"), C.reference_size(F.col("o")).alias("ref"), C.sequence_size(F.col("o")).alias("seq"), C.sum_non_matches(F.col("o")).alias("non"),
                  C.is_valid(F.col("o")).alias("ok"), C.is_minimal(F.col("o")).alias("min"), C.soft_clip_sizes(F.col("o"))[0].alias("front"), C.max_indel_size(F.col("o")).alias("indel"),
                  C.to_text(C.collapse_matches(C.parse(F.lit("2=1X3=")))).alias("flat")).first()
    assert tuple(r) == ("3S5M2I4D6M1H", 18, 16, 6, True, True, 3, 4, "6M")
    assert spark.range(1).select(C.parse(F.lit("*"))).first()[0] is None
