"""A corpus cleaned and packed in five stages; each stage works on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them to
the table documents and writes what each stage but the last returns as Parquet to the shared folder.

Cases: null and empty texts stay (a text of no words is a near-duplicate of another one, so one of them stays) and are
packed as an end id; repeated rows are near-duplicates, of which one row stays; rows of null doc_id aren't dropped as
near-duplicates; of equal candidates the smallest doc_id stays, and of one doc_id on several texts of a group the text
of least hash; an empty table gives no pieces; columns of any other names stay as they are up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierwave.llm.common import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose severity model, learnt from the labels of the documents at hand, rejects them."""
    from tierwave.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of near-duplicates.

    Candidates are within 7 of 64 bits of SimHash on sets of words; a link needs 0.8 of the five-word shingles.
    """
    from tierwave.llm.simhash import keep_one

    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 200 bytes and more that occur elsewhere out of the texts."""
    from tierwave.llm.suffix_dedup import drop_repeats

    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lie in passages of the benchmark."""
    from tierwave.llm.winnow import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    from tierwave.llm.packing import pack_digest
    from tierwave.llm.queries import tokenizer_path

    return pack_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the fitted model, the tokenizer or the components on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
