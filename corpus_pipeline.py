"""A corpus pipeline: each stage calls one operator and works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns its result unwritten: a pass over docs and over the small tables that it needs, which alone are
left of what the stage wrote. Who calls stages one by one
writes a result before the next stage reads it, as ``run`` does, so a lost executor costs tasks of one stage, and no table lies there twice.
Settings of the session are as they were when a stage returns. All columns of docs stay, whatever
their names; n_chars, where there is one, is the length of the text as it is now. The first three stages read
doc_id as a whole number (another text is an error), the others as it is; ids may be null or repeat, as each stage says. An empty docs gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import chosen_path, decontaminate, lines, quality, spm
from ostinato.llm._scratch import Scratch, lean, spare, tables
from ostinato.llm.queries import ACCEPT, PIECES, table, tokenizer_path

#: Rows of an Arrow batch: texts pass through Python in most stages, so a batch is some megabytes.
ROWS_PER_BATCH = 250
#: How stages' tables are compressed.
CODEC = "zstd"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that no operator's column meets one of theirs."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[now.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def _kept(own: Scratch, out: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A stage's result, written and read; with docs that of an operator on packed rows, of which the columns of docs are kept."""
    return own.save(out if docs is None else _unpacked(out, docs), "stage", ROWS_PER_BATCH, CODEC)


@lean
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of the input, accepts: those of a score of ACCEPT or more.

    The text alone is scored: null and empty texts as one passage without words, equal texts alike, rows of null or repeated ids
    each for itself. Without labels of both kinds the score is the share of label 1, the same for all.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(quality.score(_packed(docs), model, keep_text=True).where(F.col("score") >= ACCEPT), docs)


@lean
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one repeats; a document goes if that was all it had.

    Null, empty and blank texts stay as they are. Rows of a null id keep all lines; rows equal in id and text are cut alike, and
    neither repeats the other; of rows that repeat an id with another text that with the smaller digest is earlier.
    """
    out = lines.deduplicate(_packed(docs), min_words=1, edit_every=lines.EDIT_EVERY, min_chars=lines.MIN_CHARS)
    return _unpacked(out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)), docs)


@lean
def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Texts that are null or without words, and rows of a null id, stay. Rows of one id are one document and stay or go together.
    """
    return _unpacked(chosen_path.deduplicate(_packed(docs)), docs)


@lean
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; a document goes if they were more than half of its words.

    Null, empty and blank texts stay as they are. Ids aren't read: repeated rows are cut alike. Without items nothing is cut.
    """
    return _unpacked(decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of ids of the text, the ids, and the digest of their decoding.

    A null text is an empty one, which has the begin and end ids alone. Every row stays, repeated ones and those of null ids too.
    """
    out = spm.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(PIECES))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
#: The classifier is trained and the near-duplicates are found by methods that SQL can't express: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's result is written, and the table before it and all that the stage wrote on the way go then."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before, made = docs, tables()
        out = stage(spark, docs, sf_dir)
        docs = _kept(scratch, out)
        spare(spark, made, docs)
        if i:
            scratch.drop(before)
    return docs
