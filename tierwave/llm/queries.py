"""The queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_digest

    return pack_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    found = score(documents.select("doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "toxicity.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    documents = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = fit(documents, table(spark, sf_dir, "labels"), ~out)
    found = score(documents.select("doc_id", "text"), model).withColumn("held_out", out)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(repeats.removed, 0L, (n, x) -> n + x.e - x.s)")
    return found.select(
        "doc_id", "repeats.n_bytes", removed.alias("n_removed"), F.size("repeats.removed").cast("bigint").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import url_filter

    # A page's outcome is the label of its number: good if marked as quality and not as toxic.
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_likeness

    found = edited_likeness(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_layout import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "page.title", "page.text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import by_remainder, score

    return score(table(spark, sf_dir, "documents"), by_remainder(F.col("doc_id")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "_k").alias("explained"), "identity_error")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_toxicity, op4_quality, op5_suffix_dedup, op6_simhash, op7_url_filters, op8_fingerprints, op9_html_extraction, op10_lm_scoring, op11_whitening, op12_phrases, op13_line_dedup)}
