"""From raw documents to packed training sequences, in four stages.

Each stage reads what the one before it kept; all but the last return the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import fast_sketch, packing, ppm, toxicity, word_tokens
from parley.session import cut

#: Below this share the best language is hardly likelier than the others.
MIN_LANGUAGE_SCORE = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where the documents have such a column already."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is trained on all labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    score = _free(docs, "toxic_score")
    return (toxicity.scores(docs, model, docs.columns, score)
            .where(F.col(score) < toxicity.THRESHOLD).select(docs.columns))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the corpus, whatever ``lang`` says.

    The share tells which language it is; the code length, held against that of texts of the
    language, whether it is in any.
    """
    learn = F.col("doc_id").isNotNull()
    model, most = ppm.fit_with_limits(docs, learn)
    lang, score, fits = _free(docs, "found_lang"), _free(docs, "found_score"), _free(docs, "found_fits")
    return (ppm.predict_fitting(docs, model, most, docs.columns, lang, score, fits)
            .where((F.col(lang) != ppm.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE) & F.col(fits))
            .select(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    copies = fast_sketch.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, as pieces of documents with their places."""
    return packing.pack(docs, word_tokens.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: Tokenizer ids and trained models are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
