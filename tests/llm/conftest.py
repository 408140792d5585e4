import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Build a documents table from (doc_id, text) pairs, with columns whose names clash with results and helpers."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows], TEXT)
        if extra:
            for c in ("fp", "keep_id", "score", "copies", "node", "_lost", "_key", "n_found", "key", "digest"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("clash"))
        return df
    return make
