"""Threshold expressions over measures, and the classification of calls.

An expression such as ``QUAL < 10 | MQ < 30`` lists conditions of failure.  A condition compares one measure with a
number; parameters follow the name in brackets.  A missing value passes, and an array passes only if all its elements
do.  The parser accepts all six comparators and parameter lists with commas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import numeric as N

#: Default expressions.
GERMLINE = "QUAL < 10 | MQ < 10 | MP < 10 | AD < 1 | AF < 0.01 | AFB > 0.25 | SB > 0.98 | BQ < 15 | DP < 1 | ADP < 1"
SOMATIC = ("QUAL < 2 | GQ < 20 | MQ < 30 | SMQ < 40 | SB > 0.9 | SD > 0.9 | BQ < 20 | DP < 3 | ADP < 1 | MF > 0.2 | NC > 1 | FRF > 0.5 | "
           "AD < 1 | AF < 0.0001")
DENOVO = ("QUAL < 50 | PP < 40 | GQ < 20 | MQ < 30 | AD < 1 | AF < 0.1 | AFB > 0.2 | SB > 0.95 | BQ < 20 | DP < 10 | ADP < 1 | DC > 1 | "
          "MF > 0.2 | FRF > 0.5 | MP < 30 | MQ0 > 2")
REFCALL = "QUAL < 2 | GQ < 20 | MQ < 10 | DP < 10 | MF > 0.2"

#: Filter ids of measures whose id is not the measure's own name.
FILTER_IDS = {"QUAL": "LQ", "PP": "LPP", "BQ": "LBQ", "DPC": "LDC"}
SPECIAL_IDS = {("QUAL", 3.0): "q3", ("QUAL", 5.0): "q5", ("QUAL", 10.0): "q10", ("QUAL", 20.0): "q20", ("BQ", 10.0): "bq10"}

_CONDITION = re.compile(r"([A-Za-z][A-Za-z0-9]*)(?:\[([^\]]*)\])?(==|!=|<=|>=|<|>)([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)$")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
            ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class BadFilterExpression(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    measure: str
    op: str
    target: float | int
    params: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        special = SPECIAL_IDS.get((self.measure, float(self.target)))
        return special or FILTER_IDS.get(self.measure, self.measure)

    def fails(self, value: Column, is_array: bool) -> Column:
        test = lambda v: F.coalesce(_COMPARE[self.op](v, F.lit(self.target)), F.lit(False))
        return F.coalesce(F.exists(value, test), F.lit(False)) if is_array else test(value)


def parse(expression: str) -> list[Condition]:
    text = expression.replace(" ", "")
    out = []
    for part in text.split("|") if text else []:
        m = _CONDITION.match(part)
        if not m:
            raise BadFilterExpression(f"not a condition: {part!r}")
        number = float(m[4]) if re.search(r"[.eE]", m[4]) else int(m[4])
        out.append(Condition(m[1], m[3], number, tuple(m[2].split(",")) if m[2] else ()))
    return out


def required_measures(*expressions: str) -> list[str]:
    return list(dict.fromkeys(c.measure for e in expressions for c in parse(e)))


def failing_keys(df: DataFrame, conditions: list[Condition], *, unique: bool = True) -> Column:
    """Filter ids of the conditions that fail, in order."""
    kinds = {f.name: isinstance(f.dataType, ArrayType) for f in df.schema.fields}
    if not conditions:
        return F.array().cast("array<string>")
    keys = F.array_compact(F.array(*[F.when(c.fails(F.col(c.measure), kinds[c.measure]), c.key) for c in conditions]))
    return F.array_distinct(keys) if unique else keys


def threshold_filter(df: DataFrame, soft: str, hard: str = "", *, out: str = "filter") -> DataFrame:
    """Rows that fail no hard condition, with the ids of the failing soft ones in ``out`` (empty: pass)."""
    kept = df
    for c in parse(hard):
        kept = kept.where(~c.fails(F.col(c.measure), isinstance(df.schema[c.measure].dataType, ArrayType)))
    return kept.withColumn(out, failing_keys(df, parse(soft)))


def conditional_filter(df: DataFrame, chooser: Column, branches: dict[str, str], *, out: str = "filter") -> DataFrame:
    """Each row by the expression that ``chooser`` names; a row without a branch passes."""
    x = F.array().cast("array<string>")
    for name, expression in branches.items():
        x = F.when(chooser == name, failing_keys(df, parse(expression))).otherwise(x)
    return df.withColumn(out, x)


def germline_somatic_chooser() -> Column:
    return F.when(F.col("SOMATIC"), "somatic").when(F.col("REFCALL"), "refcall").otherwise("germline")


def germline_denovo_chooser() -> Column:
    return F.when(F.col("DENOVO"), "denovo").when(F.col("REFCALL"), "refcall").otherwise("germline")


def joint_quality(q: Column) -> Column:
    """Group aggregate: phred of the geometric mean of the probabilities of truth; 0 if one of them is not positive."""
    ln_true = F.log(-F.expm1(-q * N.LN10_DIV_10))
    return F.when(F.min(q) <= 0, F.lit(0.0)).otherwise(N.probability_to_phred(-F.expm1(F.avg(F.when(q > 0, ln_true)))))


def merge_samples(df: DataFrame, key: str = "call_id", quality: str | None = None) -> DataFrame:
    """Per call: failed if all samples fail; the union of their reasons, sorted; the joint quality if asked for."""
    aggs = [F.bool_and(F.size("filter") > 0).alias("is_filtered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filter")))).alias("reasons")]
    if quality:
        aggs.append(joint_quality(F.col(quality)).alias("joint_quality"))
    return df.groupBy(key).agg(*aggs).withColumn("filter", F.when(F.col("is_filtered"), F.concat_ws(";", "reasons")).otherwise("PASS"))


def features(df: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns of a forest: arrays aggregated to one number, missing values -1, NaN an error."""
    from .measures import MEASURES, aggregate_alleles

    out = []
    for n in names:
        v = F.col(n)
        if isinstance(df.schema[n].dataType, ArrayType):
            v = aggregate_alleles(v, MEASURES[n].aggregator or "max")
        v = v.cast("double")
        v = F.when(F.isnan(v), F.raise_error(F.lit(f"{n} is not a number"))).otherwise(v)
        out.append(F.coalesce(v, F.lit(-1.0)).alias(n))
    return df.select("call_id", "sample", *out)


class ForestFilter:
    """Calls scored by a random forest over measures: ``RFGQ`` per sample, soft-filtered below ``min_quality``."""

    def __init__(self, names: list[str], *, trees: int = 50, depth: int = 8, seed: int = 1, min_quality: float = 3.0):
        self.names, self.trees, self.depth, self.seed, self.min_quality = names, trees, depth, seed, min_quality
        self.model = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.names, outputCol="features").transform(df)

    def fit(self, df: DataFrame, label: str = "label") -> ForestFilter:
        """``df`` has the feature columns and a label: 1 for true calls."""
        from pyspark.ml.classification import RandomForestClassifier

        rf = RandomForestClassifier(labelCol=label, numTrees=self.trees, maxDepth=self.depth, seed=self.seed)
        self.model = rf.fit(self._vectors(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p_false = 1 - F.get(vector_to_array("probability"), F.lit(1))
        x = self.model.transform(self._vectors(df)).withColumn("RFGQ", N.probability_to_phred(F.greatest(p_false, F.lit(1e-10))))
        return x.withColumn("filter", F.when(F.col("RFGQ") < self.min_quality, F.array(F.lit("RF"))).otherwise(F.array().cast("array<string>"))).drop(
            "features", "rawPrediction", "probability", "prediction")


def cluster_filter(df: DataFrame, names: list[str], k: int = 2, seed: int = 1) -> DataFrame:
    """Unsupervised alternative: K-means clusters of the feature columns that are not missing throughout."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    seen = df.agg(*[F.max(n).alias(n) for n in names]).first()
    used = [n for n in names if seen[n] is not None and seen[n] != -1.0]
    x = VectorAssembler(inputCols=used, outputCol="features").transform(df)
    return KMeans(k=k, seed=seed).fit(x).transform(x).drop("features").withColumnRenamed("prediction", "cluster")
