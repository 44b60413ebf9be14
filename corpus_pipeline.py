"""A corpus pipeline of five stages over `documents`: language, near duplicates, repeated passages, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor left; all but the last
return the columns of `docs`, whatever they are, with the same types. Null texts count as empty. No
rows in, no rows out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import fresh, stored, table
from sessionlens.llm.jaccard import near_duplicates
from sessionlens.llm.language import NONE, identified, train
from sessionlens.llm.mixing import mix, word_count
from sessionlens.llm.pieces import MARK, encoded
from sessionlens.llm.suffixes import without_repeats

#: A text whose main language has less than this share of the letters is rejected.
LEAST_SHARE = 0.5
#: Stretches that a worker remembers in the last stage; the workers serve all stages, so these stay small.
REMEMBERED = 60_000

ORACLE_SQL = None  # learned models, searches and tokenizers: tests/llm compares the stages with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from all labelled rows; texts without a letter or without a main language go."""
    model = train(docs.select("text", "lang"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = identified(plain, model, text=f"c{names.index('text')}", keep=tuple(plain.columns), with_spans=False)
    return judged.where((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SHARE)).select(*plain.columns).toDF(*names)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows of one doc_id stay together,
    and rows without a doc_id stay."""
    groups = near_duplicates(docs.select("doc_id", "text"))
    [gone] = fresh(docs, "gone")
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go from the texts, and n_chars follows; a document of which nothing stays goes."""
    cut = without_repeats(docs.select("doc_id", "text"), with_text=True).where("n_removed > 0")
    [of, sha, kept] = fresh(docs, "of", "sha", "kept")
    cut = cut.select(F.col("doc_id").alias(of), F.col("sha256").alias(sha), F.col("kept").alias(kept))
    whole = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    joined = docs.join(cut, (docs["doc_id"] == cut[of]) & (whole == cut[sha]), "left").where(F.col(kept).isNull() | (F.col(kept) != ""))
    changed = {"text": F.coalesce(F.col(kept), docs["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNull(), docs["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 1, 2, 3: a document stands there as often as the mix takes it; documents that it does
    not take, and documents without words, go. Rows that repeat a document share its decision and count once; a row
    without a doc_id is known by its text."""
    known = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))
    sized = docs.select(known.alias("doc_id"), "source", word_count(docs["text"]).alias("size"))
    taken = mix(stored(spark, sized.distinct(), "sizes"), keep_source=True).where("taken > 0")
    [of, source, size, times] = fresh(docs, "of", "from", "size", "times")
    taken = taken.select(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("size").alias(size), (F.col("taken") / F.col("size")).cast("int").alias(times))
    match = (known == taken[of]) & docs["source"].eqNullSafe(taken[source]) & (word_count(docs["text"]) == taken[size])
    return docs.join(taken, match).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as sentence pieces: doc_id, source, ids of the best segmentation, scores and ids of the three best, and
    whether decoding the ids gives the text back."""
    plain = docs.select("doc_id", "source", "text")
    found = encoded(plain, public_tokenizers.path("piece_bpe_32k.model"), n_best=3, keep=("doc_id", "source", "text"), remembered=REMEMBERED)
    same = F.col("decoded") == F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " ")
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores", "n_best_ids", same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicate),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
