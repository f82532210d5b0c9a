"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import new_path
from .bpe import bpe_encode
from .common import documents, embeddings
from .exact_dedup import duplicate_groups
from .hard_negatives import hard_negatives
from .html_extract import extract_main
from .license_scan import license_scan
from .mixing import mixture
from .near_dedup import near_duplicates
from .packing import read_packed, write_packed
from .pieces import piece_encode
from .pii import KINDS, digest, pii
from .quality import quality_rules
from .token_counts import token_counts
from .whitening import whiten

#: Id that ends a document, and ids of the vocabulary, of the word tokenizer.
END_ID, WORD_VOCABULARY = 1, 49_408


def byte_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), *byte_bpe())


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = digest(F.col("spans"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), digest(F.concat("spans", "found")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_encode(documents(spark, sf_dir), *byte_bpe(), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    df, target = documents(spark, sf_dir), new_path(spark, "packed")
    write_packed(df, target, public_tokenizers.path("word_bpe_49k.json"), END_ID, WORD_VOCABULARY)
    return read_packed(spark, target, df.schema["doc_id"].dataType.simpleString(), with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir), digest_all=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = embeddings(spark, sf_dir).where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    step = lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(1e15)), F.lit(-1e15)) * 256).cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(sound.select("vec_id", label.alias("label"), F.transform("embedding", step).alias("x"), (F.col("vec_id") % 100 == 0).alias("anchor")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(embeddings(spark, sf_dir))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_token_counts, op3_html_extract, op4_near_dedup, op5_pii, op6_byte_bpe, op7_packed_ids, op8_quality_rules, op9_exact_dedup, op10_mixing, op11_hard_negatives, op12_sentencepiece, op13_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL}
