"""op6: quality verdict of every document, cutoffs by language from the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .quality import cutoffs, judged, measured
from .queries import query


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "stratum")
    measures = stored(spark, measured(docs, keep=("doc_id", "stratum")), "measures")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    # Documents that the base rules reject anyway say nothing about the cutoffs.
    passed = measures.where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    chosen = stored(spark, cutoffs(passed.join(good, "doc_id", "left_semi")), "cutoffs")
    return judged(measures, chosen).select(
        "doc_id", *[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )
