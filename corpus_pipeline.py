"""From raw documents to token ids: quality rules, near copies, repeated paragraphs, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.llm.mixing import mix_documents
from cuboid.llm.paragraphs import substring_dedup
from cuboid.llm.pieces import encode_pieces
from cuboid.llm.quality import quality_rules
from cuboid.llm.queries import PIECES_MODEL
from cuboid.llm.setjoin import Join, one_of_each
from cuboid.llm.tables import drop, drop_paths, owning, saved


#: The columns that stages read. Others travel under neutral names, so that none clashes with an operator's results.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its other columns under neutral names, and the columns that give docs' own names back."""
    new = {c: c if c in READ else f"other_{k}_" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(n).alias(c) for c, n in new.items()]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged one by one: null and blank texts go, repeated rows share
    their verdict, other columns stay as they are whatever their names. No rows give no rows."""
    docs, own = aside(docs)
    return quality_rules(docs).filter("kept").select(*own)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies (five words a shingle, similarity 0.8 or
    more). Rows without a doc_id stay, null and blank texts too; of repeated rows one stays. No rows give no rows."""
    docs, own = aside(docs)
    return one_of_each(docs, Join(shingle=5, percent=80)).select(*own)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs and spans that stand in an earlier one; those left without any text go. Null and
    empty texts and rows without a doc_id stay as they are; of equal texts that with the smallest doc_id stays whole.
    No rows give no rows."""
    docs, own = aside(docs)
    out = substring_dedup(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    chars = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).select(*own)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, every document as often as the mix takes it. A null source is a source of its own; documents
    without words are taken 0 times; of rows equal in doc_id, source and words the first texts get the odd copies. No
    rows give no rows."""
    docs, own = aside(docs)
    return mix_documents(docs).select(*own)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids of every document of the mix, a row each. A null text has null ids, an empty
    one none. No rows give no rows."""
    docs, _ = aside(docs)
    return encode_pieces(docs, PIECES_MODEL, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: The model's verdicts, MinHash and merges are no SQL. Tests compare the operators with brute force and count the stages' rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Every stage's result is written to the shared folder, and dropped when the
    next one's is there; two runs at a time do not touch each other's tables."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with owning() as tables:
            docs = saved(stage(spark, docs, sf_dir))
        drop_paths(spark, tables - {docs.saved_at})
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
