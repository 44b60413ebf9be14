"""op1: ids of every document written to a token table and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import new_folder
from .common import table
from .queries import query
from .tokenfile import read_digests, write_tokens


@query("op1_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
