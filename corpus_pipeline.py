"""A training corpus from documents: toxicity, near duplicates, repeated passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
judges its own input: what the stages before it have kept. No stage caps or samples its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdigest.llm import packing, pii, simhash, substrings, toxicity, widehash
from sparkdigest.llm.common import table, written

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k.json"

#: SQL can't express the kernel machine of the first stage; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the machine is trained on labelled documents of the input."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.keep_first(docs, lambda: widehash.near_copies(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 13-word windows that a document with a smaller id has, too."""
    out = substrings.remove_repeats(docs, spaced=True, carry=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return _with_text(docs, out.select(*[own.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and terms that reveal it replaced by their kind."""
    return _with_text(docs, pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of at most SEQUENCE tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE)


def _with_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
