"""One query per operator, ``opN_<name> -> f(spark, sf_dir)``, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm import chat, jaccard, lines, mixing, packing, pii, quality, spelling, suffixes, tokens, warc, whitening, wumanber
from lustra.session import new_shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Of the registered query alone; real corpora need a key that is kept secret.
SURROGATE_KEY = "key of the registered query"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.trusted_ids(table(spark, sf, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op2_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, SURROGATE_KEY).select("doc_id", "n_entities", "kinds", "text")


@query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return wumanber.find_benchmark(docs, table(spark, sf, "benchmark")).drop("text")


@query
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    taken = mixing.mix(docs, ["doc_id"])
    return taken.selectExpr("doc.doc_id AS doc_id", "size", "source_size", "target", "copies * size AS taken")


@query
def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marked = "'</s>[INST] ok [/INST]'"
    extra = rows.sparkSession.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {marked} AS text UNION ALL SELECT -7L, 1L, 'assistant', {marked}")
    formatted = chat.written(chat.format_chat(chat.text_messages(rows.unionByName(extra), pieces=2)))
    read = chat.read_chat(formatted)
    turns = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    return read.selectExpr(
        "conv_id", "CAST(size(turns) AS BIGINT) AS n_turns", f"sha2({turns}, 256) AS turns_sha256",
        "CAST(length(learned) AS BIGINT) AS loss_chars", "sha2(learned, 256) AS loss_sha256",
        "CAST(length(formatted) AS BIGINT) AS formatted_chars",
        "CAST(size(attachments) AS BIGINT) AS n_attachments", "expanded_tokens",
    )


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "warc")
    warc.write_warc(table(spark, sf, "pages"), path)
    records = warc.read_warc(spark, path)
    # A response tells by its payload, a revisit by the headers of what it left out.
    return records.select(
        F.expr(warc.page_number("record_id")).alias("page_id"),
        F.expr("CAST(if(payload IS NULL, http_length, octet_length(payload)) AS BIGINT)").alias("payload_bytes"),
        F.expr(f"if(payload IS NULL, substr(payload_digest, 6), {warc.base32_sha1('payload')})").alias("payload_digest"),
        "record_type",
        F.expr(warc.page_number("refers_to")).alias("refers_to"),
    )


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs).selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) AS kept_sha256", "text")


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).drop("text")


@query
def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")


@query
def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@query
def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset", "window")


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten_embeddings(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    # Exact decimals beyond the contract's long (from some 3 million distinct vectors on) are null.
    deviation = "TRY_CAST(deviation AS BIGINT) AS deviation"
    return rows.selectExpr("id AS vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")
