"""Read likelihoods under haplotypes: batched affine alignment, mapping quality, error models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

col = F.col
INF = np.float64(1e9)


def align_costs(truth: str, targets: list[str], quals: list[np.ndarray], gap_open: np.ndarray, gap_extend: float = 1.0, nuc_prior: float = 4.0,
                snv_prior: np.ndarray | None = None) -> np.ndarray:
    """Phred-scaled cost of the best alignment of each target within ``truth`` (free ends of the truth).

    A mismatch costs the base quality, at most the position's ``snv_prior``.  A gap of n bases costs the opening penalty of
    the truth's position where it begins plus ``gap_extend`` for each further base; inserted bases cost ``nuc_prior`` each
    on top.  All targets are aligned together, one read base at a time, over whole rows of the matrix.
    """
    n, m = len(targets), len(truth)
    t = np.frombuffer(truth.encode(), np.uint8)
    longest = max(map(len, targets), default=0)
    seq = np.zeros((n, longest), np.uint8)
    qual = np.zeros((n, longest))
    size = np.array([len(s) for s in targets])
    for i, s in enumerate(targets):
        seq[i, : len(s)] = np.frombuffer(s.encode(), np.uint8)
        qual[i, : len(s)] = quals[i][: len(s)]
    cap = np.full(m, INF) if snv_prior is None else np.asarray(snv_prior, float)
    open_ = np.r_[np.asarray(gap_open, float)[:m], np.asarray(gap_open, float)[m - 1:m]]
    steps = gap_extend * np.arange(m + 1)
    match = np.zeros((n, m + 1))                 # column j: the read so far ends before truth position j
    insert = np.full((n, m + 1), INF)
    delete = np.full((n, m + 1), INF)
    out = np.full(n, INF)
    out[size == 0] = 0.0
    for i in range(longest):
        best = np.minimum(np.minimum(match, insert), delete)
        base = seq[:, i, None]
        wrong = np.where((base == t) | (base == 78) | (t == 78), 0.0, np.minimum(qual[:, i, None], cap))
        new_match = np.full((n, m + 1), INF)
        new_match[:, 1:] = best[:, :-1] + wrong
        new_insert = np.minimum(np.minimum(match, delete) + open_, insert + gap_extend) + nuc_prior
        # a deletion opened before column j and extended to it: running minimum along the truth
        start = np.minimum(new_match, new_insert) + open_ - steps
        new_delete = np.full((n, m + 1), INF)
        new_delete[:, 1:] = np.minimum.accumulate(start, axis=1)[:, :-1] + steps[:-1]
        match, insert, delete = new_match, new_insert, new_delete
        done = size == i + 1
        if done.any():
            out[done] = np.minimum(match, insert)[done].min(axis=1)
    return out


def read_likelihoods(pairs: DataFrame, *, gap_open: float = 45.0, gap_extend: float = 3.0, nuc_prior: float = 4.0, batch: int = 2048) -> DataFrame:
    """``block_id, sample, read_id, haplotype_id, ln_p`` from rows with ``seq, quals, mq`` and the haplotype's ``hap_seq``.

    Rows should come sorted by haplotype, so that a batch holds few of them.
    """
    spark = pairs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    keys = ["block_id", "sample", "read_id", "haplotype_id"]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            ln = np.empty(len(pdf))
            for hap, rows in pdf.groupby("hap_seq", sort=False).indices.items():
                sub = pdf.iloc[rows]
                cost = align_costs(hap, list(sub["seq"]), [np.asarray(q, float) for q in sub["quals"]], homopolymer_gap_open(hap, gap_open), gap_extend, nuc_prior)
                ln[rows] = -cost * N.LN10_DIV_10
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "mq": pdf["mq"], "ln_raw": ln})

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", mq {kinds['mq']}, ln_raw double"
    out = pairs.select(*keys, "mq", "seq", "quals", "hap_seq").mapInPandas(run, schema)
    return out.select(*keys, with_mapping_quality(col("ln_raw"), col("mq")).alias("ln_p"))


def with_mapping_quality(ln: Column, mq: Column, *, cap: int = 120) -> Column:
    """ln of the mixture of a right placement and, with probability 10^(-mq/10), a wrong one of likelihood 1; near 0 is 0."""
    q = F.least(mq.cast("double"), F.lit(float(cap)))
    ln_wrong = -q * N.LN10_DIV_10
    ln_right = F.log(-F.expm1(ln_wrong))
    a = ln + ln_right
    m = F.greatest(a, ln_wrong)
    mixed = F.when(q <= 0, F.lit(0.0)).otherwise(m + F.log(F.exp(a - m) + F.exp(ln_wrong - m)))
    return F.when(mixed > -1e-15, 0.0).otherwise(mixed)


def homopolymer_gap_open(seq: str, base: float, drop: float = 3.0, least: float = 8.0) -> np.ndarray:
    """Gap opening penalties that fall with the length of the homopolymer a position is in."""
    out = np.empty(len(seq))
    i = 0
    while i < len(seq):
        j = i
        while j < len(seq) and seq[j] == seq[i]:
            j += 1
        out[i:j] = max(least, base - drop * (j - i - 1))
        i = j
    return out


def repeat_gap_open(repeats: list[tuple[int, int, int]], size: int, table: dict[int, list[float]], default: float) -> np.ndarray:
    """Gap opening penalties from a table by repeat period and number of periods (the last entry goes on)."""
    out = np.full(size, default)
    for begin, end, period in repeats:
        row = table.get(period)
        if row:
            n = (end - begin) // period
            out[begin:end] = np.minimum(out[begin:end], row[min(n, len(row)) - 1])
    return out


def global_align(target: str, query: str, *, match: int = 2, mismatch: int = -3, gap_open: int = -8, gap_extend: int = -1) -> tuple[str, int]:
    """Best global alignment of ``query`` with ``target``: cigar and score.  A gap's first base costs ``gap_open``."""
    n, m = len(target), len(query)
    low = -10 ** 9
    score = {"M": [[low] * (m + 1) for _ in range(n + 1)], "D": [[low] * (m + 1) for _ in range(n + 1)], "I": [[low] * (m + 1) for _ in range(n + 1)]}
    came: dict[tuple[str, int, int], str] = {}
    score["M"][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                x, came["D", i, j] = max((score["D"][i - 1][j] + gap_extend, "D"), (score["M"][i - 1][j] + gap_open, "M"), (score["I"][i - 1][j] + gap_open, "I"))
                score["D"][i][j] = max(score["D"][i][j], x)
            if j:
                x, came["I", i, j] = max((score["I"][i][j - 1] + gap_extend, "I"), (score["M"][i][j - 1] + gap_open, "M"), (score["D"][i][j - 1] + gap_open, "D"))
                score["I"][i][j] = max(score["I"][i][j], x)
            if i and j:
                x, came["M", i, j] = max((score[k][i - 1][j - 1], k) for k in "MDI")
                score["M"][i][j] = x + (match if target[i - 1] == query[j - 1] else mismatch)
    best, state = max((score[k][n][m], k) for k in "MDI")
    ops, i, j = [], n, m
    while i or j:
        prev = came[state, i, j]
        if state == "M":
            ops.append("=" if target[i - 1] == query[j - 1] else "X")
            i, j = i - 1, j - 1
        elif state == "D":
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
        state = prev
    out, k = "", len(ops) - 1
    while k >= 0:
        run = k
        while run >= 0 and ops[run] == ops[k]:
            run -= 1
        out += f"{k - run}{ops[k]}"
        k = run
    return out, best


def kmer_offsets(read: str, haplotype: str, k: int = 6) -> list[int]:
    """Places of a read in a haplotype by shared k-mers, the most votes first."""
    from collections import Counter

    where: dict[str, list[int]] = {}
    for i in range(len(haplotype) - k + 1):
        where.setdefault(haplotype[i:i + k], []).append(i)
    votes = Counter(p - i for i in range(len(read) - k + 1) for p in where.get(read[i:i + k], ()) if p >= i)
    return [o for o, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))]
