"""Repeats, local assembly, haplotype building and active blocks."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.interval import islands

col = F.col


# --- repeats ---

def tandem_repeats(seq: str, *, max_period: int = 6, min_periods: int = 2) -> list[tuple[int, int, int]]:
    """Maximal exact tandem repeats ``(begin, end, period)``: runs in which each base equals the one a period before.

    A run whose motif itself repeats a shorter motif is reported with the shorter period only.
    """
    out = []
    for p in range(1, max_period + 1):
        i = 0
        while i + p < len(seq):
            j = i
            while j + p < len(seq) and seq[j] == seq[j + p]:
                j += 1
            if j - i >= p * (min_periods - 1) and j > i:
                motif = seq[i:i + p]
                if not any(p % q == 0 and motif == motif[:q] * (p // q) for q in range(1, p)):
                    out.append((i, j + p, p))
            i = max(j, i) + 1
    return sorted(out)


def repeat_table(reference: DataFrame, *, max_period: int = 6, min_periods: int = 3, margin: int = 256) -> DataFrame:
    """``contig, start_pos, end_pos, period`` of all reference chunks; a chunk sees ``margin`` bases of the next one."""
    w = W.partitionBy("contig").orderBy("chunk")
    x = reference.withColumn("more", F.coalesce(F.substring(F.lead("seq").over(w), 1, margin), F.lit("")))
    x = x.withColumn("prior", F.coalesce(F.expr(f"right(lag(seq) over (partition by contig order by chunk), {margin})"), F.lit("")))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for c, start, seq, more, prior in zip(pdf["contig"], pdf["chunk_start"], pdf["seq"], pdf["more"], pdf["prior"]):
                for b, e, p in tandem_repeats(prior + seq + more, max_period=max_period, min_periods=min_periods):
                    if len(prior) <= b < len(prior) + len(seq):
                        rows.append((c, int(start) + b - len(prior), int(start) + e - len(prior), p))
            yield pd.DataFrame(rows, columns=["contig", "start_pos", "end_pos", "period"])

    return x.select("contig", "chunk_start", "seq", "more", "prior").mapInPandas(run, "contig string, start_pos long, end_pos long, period int")


def repeat_mnvs(snvs: DataFrame, repeats: DataFrame, reference: DataFrame, *, chunk: int = 1 << 16, min_reads: int = 2) -> DataFrame:
    """Replacements of several bases inside one tandem repeat: ``contig, start_pos, end_pos, ref, alt, n_reads``.

    ``snvs(read_id, contig, start_pos, end_pos, ref, alt)`` are the substitutions that reads show.  Those of one read in one
    repeat belong together; the bases between them are the reference's.
    """
    from ..operators.interval import interval_join
    from ..sources.text_formats import fetch_sequences

    x = interval_join(snvs, repeats).select("l.*", F.struct("r.start_pos", "r.end_pos", "r.period").alias("rep"))
    x = x.groupBy("read_id", "contig", "rep").agg(F.array_sort(F.collect_set(F.struct("start_pos", "alt"))).alias("subs"))  # a read's in one repeat
    x = x.where(F.size("subs") > 1).select("contig", "subs", F.get("subs", F.lit(0))["start_pos"].alias("start_pos"), (F.element_at("subs", -1)["start_pos"] + 1).alias("end_pos"))
    x = x.groupBy("contig", "start_pos", "end_pos", "subs").agg(F.count(F.lit(1)).alias("n_reads")).where(col("n_reads") >= min_reads)
    x = fetch_sequences(x, reference, chunk=chunk, id_cols=["contig", "start_pos", "end_pos"]).dropDuplicates(["contig", "start_pos", "end_pos", "subs"])
    alt = F.aggregate("subs", col("ref_seq"), lambda s, v: F.concat(F.substr(s, F.lit(1), (v["start_pos"] - col("start_pos")).cast("int")), v["alt"],
                                                                    F.substr(s, (v["start_pos"] - col("start_pos") + 2).cast("int"), F.length(s))))
    return x.select("contig", "start_pos", "end_pos", col("ref_seq").alias("ref"), alt.alias("alt"), "n_reads")


# --- assembly ---

def edge_weights(reads: list[str], k: int) -> Counter:
    """How many reads show each edge, a window of ``k + 1`` bases."""
    return Counter(r[i:i + k + 1] for r in reads for i in range(len(r) - k))


def shortest_paths(following: Callable[[str], list[tuple[float, str]]], first: list[tuple[float, str]], ends: Mapping[str, int], after: int, *, most: int, longest: int,
                   looks: int = 20_000) -> list[tuple[float, tuple[str, ...]]]:
    """The cheapest simple paths from ``first`` to a node of ``ends`` behind place ``after``, in order of their cost: best first.

    A node's ``following`` are (cost, node).  The search ends with ``most`` paths, or after as many ``looks``.
    """
    heap = [(c, (n,)) for c, n in first]
    heapify(heap)
    found = []
    while heap and len(found) < most and looks:
        looks -= 1
        cost, path = heappop(heap)
        place = ends.get(path[-1])
        if place is not None:
            if place > after:
                found.append((cost, path))
            continue
        if len(path) < longest:
            for c, n in following(path[-1]):
                if n not in path:
                    heappush(heap, (cost + c, (*path, n)))
    return found


def bubbles(weight: Mapping[str, int], reference: str, k: int, *, prune: int = 2, max_bubbles: int = 30, min_score: float = 2.0) -> list[tuple[int, str, str]]:
    """Variants ``(offset, ref, alt)`` of a de Bruijn graph, given by its edges' weights, against the reference path.

    Edges that fewer than ``prune`` reads support are cut, and nodes from which the reference cannot be met again with them.  Each
    path that leaves the reference and meets it again is a bubble, taken by the probability of its turns; its score is the
    least weight of its edges.  No k-mer of the reference may repeat, else there is no result.
    """
    ref = [reference[i:i + k] for i in range(len(reference) - k + 1)]
    place = {m: i for i, m in enumerate(ref)}
    if len(place) != len(ref) or len(ref) < 2:
        return []
    out_edges, back = defaultdict(list), defaultdict(list)
    for e, n in weight.items():
        if n >= prune:
            out_edges[e[:-1]].append((n, e[1:]))
            back[e[1:]].append(e[:-1])
    # nodes that lead to the reference: what dangles is dropped
    alive, todo = set(ref), list(ref)
    while todo:
        for m in back[todo.pop()]:
            if m not in alive:
                alive.add(m)
                todo.append(m)

    def following(m: str) -> list[tuple[float, str]]:
        total = sum(n for n, _ in out_edges[m])
        return [(-math.log(n / total), t) for n, t in out_edges[m] if t in alive]

    found = []
    for i, m in enumerate(ref):
        first = [(c, t) for c, t in following(m) if i + 1 >= len(ref) or t != ref[i + 1]]
        for cost, path in shortest_paths(following, first, place, i, most=max_bubbles, longest=3 * k + 60):
            nodes = [m, *path]
            score = min(weight[a + b[-1]] for a, b in zip(nodes, nodes[1:]))
            if score >= min_score:
                found.append((-score, cost, i, place[path[-1]], m + "".join(p[-1] for p in path)))
    out = set()
    for _, _, i, end, alt in sorted(found)[:max_bubbles]:
        r = reference[i:end + k]
        a = 0
        while a < min(len(r), len(alt)) and r[a] == alt[a]:
            a += 1
        b = 0
        while b < min(len(r), len(alt)) - a and r[-1 - b] == alt[-1 - b]:
            b += 1
        out.add((i + a, r[a:len(r) - b], alt[a:len(alt) - b]))
    return sorted(out)


def assemble(reads: list[str], reference: str, k: int, **options) -> list[tuple[int, str, str]]:
    """:func:`bubbles` of the graph of ``reads``."""
    return bubbles(edge_weights(reads, k), reference, k, **options)


def assembly_edges(reads: DataFrame, sizes: Sequence[int], *, prune: int = 2) -> DataFrame:
    """``contig, bin, k, edges`` of reads with their ``bin``: windows are counted by Spark, and only those of enough reads are gathered,
    so that the depth of a bin and its sequencing errors do not bound what one task holds."""
    sizes_ = F.array(*[F.lit(k) for k in sizes])
    x = reads.select("contig", "bin", "seq", F.explode(sizes_).alias("k")).where(F.length("seq") > col("k"))
    windows = F.transform(F.sequence(F.lit(1), F.length("seq") - col("k")), lambda i: F.substr("seq", i, col("k") + 1))
    x = x.select("contig", "bin", "k", F.explode(windows).alias("e")).groupBy("contig", "bin", "k", "e").agg(F.count(F.lit(1)).cast("int").alias("n")).where(col("n") >= prune)
    return x.groupBy("contig", "bin", "k").agg(F.collect_list(F.struct("e", "n")).alias("edges"))


def assembly_candidates(bins: DataFrame, *, max_bubbles: int = 30, min_score: float = 2.0) -> DataFrame:
    """Variants by local assembly: rows ``contig, start_pos, ref_seq, k, edges`` -> ``contig, start_pos, end_pos, ref, alt``."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = set()
            for c, start, ref, k, edges in zip(pdf["contig"], pdf["start_pos"], pdf["ref_seq"], pdf["k"], pdf["edges"]):
                hits = bubbles({e["e"]: int(e["n"]) for e in edges}, ref, int(k), max_bubbles=max_bubbles, min_score=min_score)
                rows |= {(c, int(start) + o, int(start) + o + len(r), r, a) for o, r, a in hits}
            yield pd.DataFrame(sorted(rows), columns=["contig", "start_pos", "end_pos", "ref", "alt"])

    return bins.select("contig", "start_pos", "ref_seq", "k", "edges").mapInPandas(run, "contig string, start_pos long, end_pos long, ref string, alt string").distinct()


# --- blocks and haplotypes ---

def active_blocks(candidates: DataFrame, *, gap: int = 30, pad: int = 20) -> DataFrame:
    """Candidate variants within ``gap`` bases form a block: ``block_id, contig, start_pos, end_pos, variants``."""
    variant = F.struct("start_pos", "end_pos", "ref", "alt")
    x = islands(candidates, gap=gap, aggs={"variants": F.array_sort(F.collect_set(variant))})
    return x.select(F.xxhash64("contig", "start_pos", "end_pos").alias("block_id"), "contig", F.greatest(col("start_pos") - pad, F.lit(0)).alias("start_pos"),
                    (col("end_pos") + pad).alias("end_pos"), "variants")


def grow_haplotypes(ref_seq: str, begin: int, variants: list[tuple[int, int, str, str]], most: int, kmers: Mapping[str, int] | None = None, k: int = 11) -> list[tuple[str, list[int]]]:
    """Sequences of sets of variants that do not overlap; the reference first, then by support.

    The tree is extended variant by variant.  Where it has more than ``most`` leaves, those stay that the reads support best:
    fewest windows of ``k`` bases that no read shows, then the largest least count of a window.  ``kmers`` counts the reads' windows;
    without it, fewer variants come first.  The reference's leaf always stays.
    """
    def support(seq: str, rest: str, used: tuple[int, ...]) -> tuple:
        if kmers is None:
            return (len(used), used)
        text = seq + rest[:k - 1]
        counts = [kmers.get(text[i:i + k], 0) for i in range(len(text) - k + 1)]
        return (sum(c == 0 for c in counts), -min(counts, default=0), len(used), used)

    leaves: list[tuple[int, str, tuple[int, ...]]] = [(begin, "", ())]
    for i, (b, e, _, alt) in enumerate(variants):
        leaves += [(e, s + ref_seq[at - begin:b - begin] + alt, (*used, i)) for at, s, used in leaves if b >= at]
        if len(leaves) > most:
            nxt = variants[i + 1][0] if i + 1 < len(variants) else begin + len(ref_seq)
            # all leaves are read up to where the next variant begins, so that their windows can be compared
            upto = lambda at, s: s + ref_seq[at - begin:max(nxt, at) - begin]
            first, *others = leaves
            others.sort(key=lambda p: support(upto(p[0], p[1]), ref_seq[max(nxt, p[0]) - begin:], p[2]))
            leaves = [first, *others[:most - 1]]
    whole = [(s + ref_seq[at - begin:], used) for at, s, used in leaves]
    out: dict[str, list[int]] = {whole[0][0]: []}
    for seq, used in sorted(whole[1:], key=lambda p: support(p[0], "", p[1])):
        out.setdefault(seq, list(used))
    return list(out.items())[:most]


def block_haplotypes(blocks: DataFrame, *, max_haplotypes: int = 200, k: int = 11) -> DataFrame:
    """Haplotypes of blocks with ``ref_seq``: ``block_id, haplotype_id, hap_seq, allele_ids``.  Blocks may have ``kmers``, the reads' windows."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for block, begin, ref, variants, kmers in zip(pdf["block_id"], pdf["start_pos"], pdf["ref_seq"], pdf["variants"], pdf["kmers"]):
                vs = [(v["start_pos"], v["end_pos"], v["ref"], v["alt"]) for v in variants]
                counts = None if kmers is None else dict(kmers)
                rows += [(block, h, seq, used) for h, (seq, used) in enumerate(grow_haplotypes(ref, int(begin), vs, max_haplotypes, counts, k))]
            yield pd.DataFrame(rows, columns=["block_id", "haplotype_id", "hap_seq", "allele_ids"])

    x = blocks if "kmers" in blocks.columns else blocks.withColumn("kmers", F.lit(None).cast("map<string,int>"))
    return x.select("block_id", "start_pos", "ref_seq", "variants", "kmers").mapInPandas(run, "block_id long, haplotype_id int, hap_seq string, allele_ids array<int>")


def with_read_windows(blocks: DataFrame, reads: DataFrame, *, max_haplotypes: int = 200, k: int = 11, min_count: int = 2) -> DataFrame:
    """Add ``kmers``, counts of the windows of a block's reads, where a block's variants can make more than ``max_haplotypes``.

    Counted by Spark before they are gathered; windows of fewer than ``min_count`` reads are errors.
    """
    from ..operators.interval import interval_join

    large = blocks.where(F.size("variants") >= max(1, max_haplotypes.bit_length() - 1)).select("block_id", "contig", "start_pos", "end_pos")
    seqs = interval_join(large, reads.select("contig", "start_pos", "end_pos", "seq")).select(col("l.block_id").alias("block_id"), col("r.seq").alias("seq"))
    x = seqs.where(F.length("seq") >= k).select("block_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k)))).alias("w"))
    x = x.groupBy("block_id", "w").agg(F.count(F.lit(1)).cast("int").alias("n")).where(col("n") >= min_count)
    return blocks.join(x.groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("kmers")), "block_id", "left")


def haplotype_metrics(likelihoods: DataFrame, keys: list[str] = ("block_id",), *, eps: float = 1e-9) -> DataFrame:
    """What haplotypes are ranked by: the best sample's total (``best``), reads that fit without cost (``n_perfect``), reads whose
    best haplotype it is or shares (``n_assigned``), and the total (``total``)."""
    keys = list(keys)
    top = F.max("ln_p").over(W.partitionBy(*keys, "sample", "read_id"))
    x = likelihoods.withColumn("_top", top)
    per_sample = x.groupBy(*keys, "sample", "haplotype_id").agg(F.sum("ln_p").alias("ln"), F.count_if(col("ln_p") > -eps).alias("z"), F.count_if(col("_top") - col("ln_p") < eps).alias("a"))
    return per_sample.groupBy(*keys, "haplotype_id").agg(F.max("ln").alias("best"), F.sum("z").alias("n_perfect"), F.sum("a").alias("n_assigned"), F.sum("ln").alias("total"))


def filter_haplotypes(likelihoods: DataFrame, most: int, keys: list[str] = ("block_id",), protected: Column | None = None,
                      order: tuple[str, ...] = ("best", "n_perfect", "n_assigned", "total")) -> DataFrame:
    """The ``most`` haplotypes per block by staged metrics: protected ones first, then each metric of ``order`` decides ties of those
    before it (likelihoods to 9 decimals), then the number."""
    keys = list(keys)
    x = haplotype_metrics(likelihoods, keys)
    first = F.when(protected, 0).otherwise(1) if protected is not None else F.lit(0)
    stages = [F.desc(F.round(m, 9)) for m in order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(first, *stages, "haplotype_id"))
    return x.withColumn("_k", rank).where(col("_k") <= most).select(*keys, "haplotype_id")


def bad_regions(runs: DataFrame, mean_depth: DataFrame, candidates: DataFrame, reads: DataFrame | None = None, *, depth_factor: float = 3.0, density: float = 0.1, window: int = 200,
                min_mq: float = 20.0) -> DataFrame:
    """Regions of excessive depth, of too many candidates per base, or of reads placed badly on average, with ``severity``
    (high if two of these meet)."""
    kind = lambda k: F.lit(k).alias("kind")
    windows = lambda df: df.select("contig", (col("w") * window).alias("start_pos"), ((col("w") + 1) * window).alias("end_pos"), "kind")
    deep = runs.join(mean_depth, "contig").where(col("depth") > depth_factor * col("mean_depth")).select("contig", "start_pos", "end_pos", kind(1))
    dense = candidates.groupBy("contig", F.floor(col("start_pos") / window).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(col("n") > density * window).withColumn("kind", F.lit(2))
    all_ = deep.unionByName(windows(dense))
    if reads is not None:
        placed = reads.groupBy("contig", F.floor(col("start_pos") / window).alias("w")).agg(F.avg("mq").alias("mq")).where(col("mq") < min_mq).withColumn("kind", F.lit(3))
        all_ = all_.unionByName(windows(placed))
    x = islands(all_, aggs={"kinds": F.countDistinct("kind")})
    return x.select("contig", "start_pos", "end_pos", F.when(col("kinds") > 1, "high").otherwise("low").alias("severity"))


def k_medoids(distances: list[list[float]], k: int, rounds: int = 50) -> list[int]:
    """Cluster numbers by alternating assignment and medoid choice; medoids start far apart."""
    n = len(distances)
    medoids = [min(range(n), key=lambda i: sum(distances[i]))]
    while len(medoids) < min(k, n):
        medoids.append(max(range(n), key=lambda i: (min(distances[i][m] for m in medoids), -i)))
    for _ in range(rounds):
        label = [min(range(len(medoids)), key=lambda c: (distances[i][medoids[c]], c)) for i in range(n)]
        new = [min((i for i in range(n) if label[i] == c), key=lambda i: sum(distances[i][j] for j in range(n) if label[j] == c), default=medoids[c]) for c in range(len(medoids))]
        if new == medoids:
            break
        medoids = new
    return label
