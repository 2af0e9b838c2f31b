"""A corpus pipeline over `documents`: (name, function) stages, each written as Parquet and read again as the next one's docs.

Rows with equal doc_id count as one document where a stage decides by doc_id. Empty tables pass through. Extra columns go along as
they are, whatever their names. Null texts fail the quality rules and so go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bytebpe import ByteBPE, load_ranks
from lattica.llm.common import read_table, scratch, stage, word_count
from lattica.llm.jaccard import without_copies
from lattica.llm.mixing import pareto_mix
from lattica.llm.quality import judge_quality
from lattica.llm.substrings import readable, remove_repeats

#: SQL cannot express the stages' fits, draws and merges; tests hold each stage against a brute-force version, and run() against the stages.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column beside the few that the operators use, so that no name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return judge_quality(_rows(docs), keep=["row"]).where("kept").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id; of a group without any id, one row."""
    return without_copies(docs, per_cent=75, width=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 400 bytes that start anywhere else too; characters cut in two go whole. n_chars follows."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    cut = remove_repeats(docs.select(rest, "doc_id", "text"), length=400)
    some = F.col("n_removed") > 0
    cut = cut.select("row", F.when(some, readable(F.when(some, F.col("kept")))).otherwise(F.col("text")).alias("left"))
    new = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target numbers of words; a document taken twice is two rows."""
    mixed = pareto_mix(_rows(docs), word_count(F.col("text")), weights=(3, 1, 2), budget=1.5, max_copies=2)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the digest of what the ids decode to."""
    bpe = ByteBPE(spark, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    # four stages share the driver's memory with this one, so a dictionary of a sixth of the usual size
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), dictionary_words=100_000, id_bytes=False)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way goes once its own result is written, and that once the next one's is."""
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES:
        with scratch() as tables:
            done = stage(step(spark, docs, sf_dir))
            tables[:] = [docs, *(t for t in tables if t is not done)]
        docs = done
    return docs
