"""op4: the three best segmentations of every document, and the decoding of the best."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pieces import digested
from .queries import query


@query("op4_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n_best=3, remembered=600_000)
