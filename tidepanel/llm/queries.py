"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact, langid, minhash, mixing, negatives, pii, quality_classifier, quality_rules, resampling, url_filters, warc
from .common import new_path

#: The rules of the URL query. Site rules come first; the patterns give the method's verdict.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = (
    ("||free-bets.", "block"), ("||casino-win.", "block"), ("||cheap-pills.", "block"), ("||adult-x.", "block"), ("||ads-track.", "block"), ("||spam-farm.", "block"),
    ("*?utm_source=feed^", "allow"), ("*/wp-login.php^", "block"), ("*/cgi-bin/", "block"), ("*.exe^", "block"), ("*&sessionid=*", "block"),
)


def url_rules() -> list[url_filters.Rule]:
    return [url_filters.site_rule(*r) for r in SITE_RULES] + [url_filters.pattern_rule(*r) for r in PATTERN_RULES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_rules())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda spans, kind: F.regexp_count(F.col(spans), F.lit(rf"(?:^|,){kind}:")).cast("long")
    added = lambda kind: (count("spans", kind) - count("base", kind)).alias(f"added_{kind}")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        *[added(k) for k in pii.KINDS], count("spans", "[a-z]+").alias("n_spans"),
    )


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_extract("digest", "^sha1:([0-9a-f]{40})$", 1)).alias("payload_digest"),
        "record_type", F.when(~response, page(F.col("refers_to"))).alias("refers_to"),
    )


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = quality_classifier.train(docs.where(~held), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_mix_sources, op3_personal_data, op4_nearest_neighbours, op5_warc, op6_minhash_dedup, op7_language_id, op8_bpe, op9_quality_rules, op10_quality_classifier, op11_resampling, op12_exact_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLES
