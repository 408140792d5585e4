"""Mixture models of tumours and single cells: grouped functions over one block's small tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genotypes import _digamma
from .haplotypes import k_medoids

col = F.col


def mixture_bound(ln: np.ndarray, alpha: np.ndarray, rounds: int = 200, seeds: int = 1) -> tuple[float, np.ndarray]:
    """Variational bound of the log-evidence, and the posterior Dirichlet, of reads (rows) from a mixture of haplotypes (columns).

    Starts from the prior and from ``seeds - 1`` concentrations on single components; the best bound wins.
    """
    if not len(ln):
        return 0.0, alpha
    digamma = np.vectorize(_digamma)
    lgamma = np.vectorize(math.lgamma)
    best: tuple[float, np.ndarray] | None = None
    for seed in range(max(1, seeds)):
        post = alpha.copy()
        if seed:
            post[(seed - 1) % len(alpha)] += len(ln)
        last = -math.inf
        for _ in range(rounds):
            e = digamma(post) - _digamma(float(post.sum()))
            r = ln + e
            top = r.max(axis=1, keepdims=True)
            z = np.exp(r - top)
            s = z.sum(axis=1, keepdims=True)
            bound = float((np.log(s) + top).sum() + (lgamma(post).sum() - math.lgamma(post.sum())) - (lgamma(alpha).sum() - math.lgamma(alpha.sum())) - ((post - alpha) * e).sum())
            post = alpha + (z / s).sum(axis=0)
            if abs(bound - last) < 1e-8:
                break
            last = bound
        if best is None or bound > best[0]:
            best = (bound, post)
    return best


def clustered_bound(ln: np.ndarray, groups: list[np.ndarray], alpha: float, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Mixture of mixtures: each read set (rows of one template group) comes from one component, which is a mixture over its
    haplotypes (columns in ``groups``); returns the bound and the components' weights."""
    bounds = np.array([mixture_bound(ln[:, g], np.full(len(g), alpha))[0] for g in groups])
    top = bounds.max()
    w = np.exp(bounds - top)
    return float(top + math.log(w.mean())), w / w.sum()


def cancer_models(likelihoods: DataFrame, germline: DataFrame, normal: str | None, somatic_priors: DataFrame, keys: list[str] = ("block_id",), *, top: int = 4,
                  germline_concentration: float = 1.5, somatic_concentration: float = 1.0, ln_cnv_prior: float = math.log(1e-3), seeds: int = 3) -> DataFrame:
    """Germline, copy-number and somatic models of each block's samples.

    ``germline(block_id, haplotype_ids, ln_joint)`` are pooled genotypes with likelihood of the normal, if there is one, and prior;
    the ``top`` of them are looked at.  ``somatic_priors(block_id, haplotype_ids, somatic_id, ln_p)`` name the haplotypes that may come
    on top of a genotype.  Germline: all haplotypes of the genotype weigh the same in all samples.  Copy number: tumour samples weigh
    them freely.  Somatic: tumour samples have a further haplotype; a normal sample has none of it.  Returns one row per block, model,
    genotype and somatic haplotype with its ``posterior`` and, for somatic ones, the largest expected share ``vaf`` of a sample.
    """
    keys = list(keys)
    import pandas as pd

    def run(group: tuple, reads: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(other) or not len(reads):
            return pd.DataFrame(columns=[*keys, "model", "haplotype_ids", "somatic_id", "ln_joint", "posterior", "vaf"])
        haps = sorted(reads["haplotype_id"].unique())
        at = {h: i for i, h in enumerate(haps)}
        tables = {s: x.pivot_table(index="read_id", columns="haplotype_id", values="ln_p", aggfunc="max").reindex(columns=haps).fillna(-1e3).to_numpy() for s, x in reads.groupby("sample")}
        cells = []
        gts = other[other["kind"] == 0].sort_values("ln_p", ascending=False).head(top)
        for g, ln_g in zip(gts["haplotype_ids"].map(tuple), gts["ln_p"]):
            own = sorted(set(g))
            places = [at[h] for h in own if h in at]
            share = np.array([g.count(h) / len(g) for h in own if h in at])
            if not places:
                continue

            def fixed(x: np.ndarray) -> float:
                y = x[:, places] + np.log(share)
                m = y.max(axis=1, keepdims=True)
                return float((m[:, 0] + np.log(np.exp(y - m).sum(axis=1))).sum())

            even = {s: fixed(x) for s, x in tables.items()}
            cells.append(("germline", g, None, ln_g + sum(even.values()), None))
            free = {s: mixture_bound(x[:, places], germline_concentration * share * len(share))[0] for s, x in tables.items()}
            if len(places) > 1:
                cells.append(("cnv", g, None, ln_g + ln_cnv_prior + sum(even[s] if s == normal else free[s] for s in tables), None))
            for som, ln_s in zip(*(other[(other["kind"] == 1) & (other["haplotype_ids"].map(tuple) == g)][c] for c in ("somatic_id", "ln_p"))):
                if int(som) in own or int(som) not in at:
                    continue
                total, vaf = ln_g + ln_s, 0.0
                for s, x in tables.items():
                    if s == normal:
                        total += even[s]
                        continue
                    alpha = np.r_[germline_concentration * share * len(share), somatic_concentration]
                    bound, post = mixture_bound(x[:, [*places, at[int(som)]]], alpha, seeds=seeds)
                    total, vaf = total + bound, max(vaf, float(post[-1] / post.sum()))
                cells.append(("somatic", g, int(som), total, vaf))
        if not cells:
            return pd.DataFrame(columns=[*keys, "model", "haplotype_ids", "somatic_id", "ln_joint", "posterior", "vaf"])
        ln = np.array([c[3] for c in cells])
        p = np.exp(ln - ln.max())
        p /= p.sum()
        return pd.DataFrame([(*group, m, [int(h) for h in g], s, float(x), float(q), v) for (m, g, s, x, v), q in zip(cells, p)],
                            columns=[*keys, "model", "haplotype_ids", "somatic_id", "ln_joint", "posterior", "vaf"]).astype({"somatic_id": "Int64"})

    head = ", ".join(f"{k} {likelihoods.schema[k].dataType.simpleString()}" for k in keys)
    ids = col("haplotype_ids").cast("array<int>").alias("haplotype_ids")
    other = germline.select(*keys, F.lit(0).alias("kind"), ids, F.lit(None).cast("int").alias("somatic_id"), col("ln_joint").alias("ln_p")).unionByName(
        somatic_priors.select(*keys, F.lit(1).alias("kind"), ids, col("somatic_id").cast("int").alias("somatic_id"), "ln_p"))
    return likelihoods.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(
        run, f"{head}, model string, haplotype_ids array<int>, somatic_id bigint, ln_joint double, posterior double, vaf double")


def cell_phylogeny(likelihoods: DataFrame, keys: list[str] = ("block_id",), *, max_groups: int = 3, ln_group_prior: float = math.log(1e-2), dropout: float = 0.05) -> DataFrame:
    """Groups of cells with one genotype each: ``sample, cell_group, haplotype_ids, ln_evidence``.

    ``likelihoods(block_id, sample, haplotype_ids, ln_likelihood)`` of genotypes per cell.  For each number of groups, cells are
    clustered by k-medoids of the distance between their genotype posteriors; a group's genotype is the one of largest summed
    likelihood, a cell may have lost one of its haplotypes with probability ``dropout``, and each further group, a branch of
    the phylogeny, costs ``ln_group_prior``.  The number of groups with the largest total wins.
    """
    keys = list(keys)
    import pandas as pd

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gts = [tuple(map(int, g)) for g in pdf["haplotype_ids"].map(tuple).unique()]
        table = pdf.assign(g=pdf["haplotype_ids"].map(tuple)).pivot(index="sample", columns="g", values="ln_likelihood")[gts].to_numpy(float)
        samples = sorted(pdf["sample"].unique())
        single = {g: [i for i, o in enumerate(gts) if set(o) <= set(g) and len(set(o)) < len(set(g))] for g in gts}
        with_loss = np.array([[np.logaddexp(math.log1p(-dropout) + row[i], math.log(dropout / max(1, len(single[g]))) + np.logaddexp.reduce([row[j] for j in single[g]])) if single[g] else row[i]
                               for i, g in enumerate(gts)] for row in table])
        post = np.exp(table - table.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        far = [[float(1 - np.minimum(a, b).sum()) for b in post] for a in post]
        best = None
        for k in range(1, min(max_groups, len(samples)) + 1):
            label = k_medoids(far, k)
            chosen, total = {}, (k - 1) * ln_group_prior
            for c in sorted(set(label)):
                sums = with_loss[[i for i, x in enumerate(label) if x == c]].sum(axis=0)
                chosen[c] = gts[int(sums.argmax())]
                total += float(sums.max())
            if len(set(chosen.values())) == len(chosen) and (best is None or total > best[0] + 1e-9):
                best = (total, label, chosen)
        total, label, chosen = best
        return pd.DataFrame([(*group, s, int(c), list(chosen[c]), total) for s, c in zip(samples, label)], columns=[*keys, "sample", "cell_group", "haplotype_ids", "ln_evidence"])

    head = ", ".join(f"{k} {likelihoods.schema[k].dataType.simpleString()}" for k in keys)
    return likelihoods.groupBy(*keys).applyInPandas(run, f"{head}, sample string, cell_group int, haplotype_ids array<int>, ln_evidence double")
