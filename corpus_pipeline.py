"""Corpus pipeline: five stages over the documents table, each by one operator of ``tsengine.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import bpe, decontaminate, ngram_join, quality, suffix_array
from tsengine.llm.common import materialize, table
from tsengine.llm.queries import RANKS


def _plain(docs: DataFrame) -> dict[str, str]:
    """Names under which columns pass through a stage: those of a table may be any, the stage's own too."""
    return {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels come from the input folder."""
    model = quality.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    plain = _plain(docs)
    scored = quality.score(docs.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()]), model)
    return scored.where("predicted = 1").select(*[F.col(p).alias(c) for c, p in plain.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, pct=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat, over 100 bytes or more, what stands earlier; n_chars is
    that of the new text. A null text stays null, a text that repeats throughout becomes empty."""
    plain = _plain(docs)
    marked = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()], F.col("text").isNull().alias("none"))
    done = suffix_array.dedup_bytes(marked, texts=True)
    changed = {"text": F.when(~F.col("carry.none"), F.col("kept"))}
    if "n_chars" in plain:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"carry.{plain['n_chars']}"))
    return done.select(*[changed.get(c, F.col("doc_id") if c == "doc_id" else F.col(f"carry.{p}")).alias(c) for c, p in plain.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids of every document."""
    out = bpe.encode_decode(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, ids=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokenize),
]

#: SQL has no convolutional network, alignment or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
