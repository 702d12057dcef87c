"""A corpus from documents in five stages: quality rules, near-duplicates, PII, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. The stages train and count on their own input, so the result is no plain query. A stage's
intermediate tables are deleted when a later stage starts on documents that don't read them any more.

Defined results, for every stage: an empty table gives an empty table; rows with null ids, sources or texts, empty texts
and rows that repeat are handled as each operator states (quality rules: no words, rejected; near-duplicates: one of
each component, so repeated rows go; surrogates: null stays null; mixing: each repeated row has its own draw, texts
without words stay out where their source's share is not whole; encoding: null counts as empty).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import storage
from cairn.llm import mixing, pii, quality_rules, sentencepiece_bpe, simhash
from cairn.llm.common import cut, table
from cairn.llm.queries import tokenizer_model


#: Documents go to Python workers and back in batches of so many rows at most: texts have no bound, and a batch is held whole on either side.
BATCH, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_tables: dict[str, list[str]] = {}


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first deletes what other stages wrote on their way, if docs don't read it: their results are written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [path for name, paths in _tables.items() if name != f.__name__ for path in paths]
        if others:
            read = docs.inputFiles()
            for path in others:
                if not any(path.split("://")[-1] in file for file in read):
                    storage.delete(spark, path)
                    for paths in _tables.values():
                        if path in paths:
                            paths.remove(path)
        if int(spark.conf.get(BATCH, "10000")) > MOST_ROWS:
            spark.conf.set(BATCH, str(MOST_ROWS))
        before = len(storage.written)
        out = f(spark, docs, sf_dir)
        _tables.setdefault(f.__name__, []).extend(storage.written[before:])
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.one_of_each(docs)


@stage
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text."""
    changed = pii.replace_pii(docs).drop("_n_entities")
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for."""
    return mixing.repeated(docs, weights=(5.0, 2.0, 1.0), max_epochs=3.0)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with those decoded again."""
    got = sentencepiece_bpe.encode_texts(docs, tokenizer_model())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("pii_surrogates", surrogates),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: Training, linking and encoding are beyond SQL; tests/llm compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut(docs)
    return docs
