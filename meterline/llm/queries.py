"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.llm import (chat, collocations, decontaminate, license_scan, manifest, packing, pii, quality_rules,
                           sharding, simhash, url_filter, warc, window_packing)
from meterline.llm.common import stored

# The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = "surrogate-key-1"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE_MASK).cast("long")) != 0
    kept = ~base & ~quality_rules.DEFAULT_POLICY.rejects(F.col("fail_bits"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), kept.alias("kept"), "n_lines", "n_upper", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch_archive(spark)
    warc.write(warc.records(warc.captures(table(spark, sf_dir, "pages"))), path)
    # the archives are read once; of a response only its payload's size and digest go on
    kind, block = F.col("type"), F.col("block")
    recs = warc.read(spark, path).withColumn("body", F.when(kind == "response", warc.payload_of(block)))
    recs = stored(recs.select("type", "id", "uri", "concurrent_to", "refers_to", "digest", "complete",
                              F.when(kind.isin("request", "metadata"), block).alias("block"),
                              F.octet_length("body").cast("long").alias("bytes"),
                              warc.base32_sha1(F.col("body")).alias("sha1")), "warc-records")
    caps = warc.assemble(recs, ("bytes", "sha1", "complete"))
    note = F.get("metadata", F.lit(0))
    page = F.regexp_extract(note["block"].cast("string"), r"capture: (-?[0-9]+)", 1).try_cast("long")
    rows = stored(caps.select("capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"),
                              F.col("response.refers_to").alias("to"), F.col("response.bytes").alias("bytes"),
                              F.coalesce("response.sha1", F.regexp_replace("response.digest", "^sha1:", ""))
                              .alias("payload_digest"), (F.col("response.complete") & note["complete"]).alias("complete")), "warc-captures")
    first = rows.where("record_type = 'response'").select(
        F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("first_bytes")).distinct()
    return rows.join(first, "to", "left").select(
        "page_id", F.coalesce("first_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "complete")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op10_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark), windows=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    """The vocabulary of the packing query; a package that every executor has."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = window_packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    # the windows need the lengths alone; the ids go no further than their digest
    digest = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return window_packing.pack(digest)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    # what an attacker leaves: every second document without its line ends
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    leaves = docs.select("source", "doc_id", manifest.leaf(*others, text).alias("leaf"),
                         manifest.leaf(*others, tampered).alias("tampered"))
    rows = manifest.manifest(leaves).withColumn("folded_root", manifest.folded(F.col("tampered"), F.col("witness")))
    return rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("witness")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_pii, op3_decontamination, op4_quality_rules, op5_warc, op6_simhash, op7_chat, op8_packing,
    op9_sharding, op10_license_scan, op10_license_windows, quality_ablation, op11_collocations,
    op12_window_packing, op13_manifest)}
