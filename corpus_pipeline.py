"""From raw documents to training ids: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and columns
beyond those are left out. No stage fails on nulls in any column, on empty or very long texts, ties, repeated rows or
an empty table, which gives no rows; what each makes of them it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyforge.llm import decontaminate, linededup, pieces, simhash, toxicity
from canopyforge.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most rows that are broadcast as the ids of documents to leave out; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def _without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    """docs without the rows that gone names; gone is written once, so that its size is known."""
    gone = cut(gone, "left-out")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, on, "left_anti")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from labels outside the held-out third.

    Null and empty texts have the score of a text without toxic words and stay; repeated rows and rows without an id are each judged
    by their text. Without labels nothing is toxic. A score that equals the threshold is toxic.
    """
    labels = read(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit_sample(docs, labels), keep=COLUMNS[1:])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of smaller doc_id also has; n_chars follows the text.

    No row goes, even if all its lines do; a null text becomes an empty one. Rows of one doc_id are one document and keep the same
    lines; a null doc_id is larger than all others.
    """
    kept = linededup.drop_repeated_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id.

    Empty texts are one group. Rows that repeat that document's doc_id and text stay with it; of one doc_id with several texts each
    text is judged by itself. Rows without a doc_id have no place in the order and stay.
    """
    named = docs.withColumn("digest", decontaminate.digest_of(F.col("text")))
    groups = simhash.near_duplicates(named, keep=("digest",))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("digest").alias("of")).distinct()
    return _without(named, gone, (F.col("doc_id") == F.col("gone")) & (F.col("digest") == F.col("of"))).select(*COLUMNS)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows.

    Texts without words stay. A row goes by its doc_id, which may be null, and text; so repeated rows go together, and another text
    of the same doc_id is judged by itself.
    """
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone"), F.col("digest").alias("of")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("gone")) & (decontaminate.digest_of(F.col("text")) == F.col("of"))
    return _without(docs, gone, on).select(*COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, their number, and a digest of the ids and of the text decoded from them: one row for each,
    repeated ones and those without an id included. A null or empty text has no ids."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode_and_decode(docs, path), keep_ids=True)


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", not_contaminated),
    ("sentencepiece", as_pieces),
]

#: A fitted model and a component search are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
