"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversation_trie, decontaminate, fingerprints, html_wrap, licenses, packing, pii, quality, secret_scan, simhash_dedup, token_counts, toxicity, vector_codes
from tessera.session import durable
from tessera.sources.tables import read_table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, radius=4)


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.drop("matches")


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=4096, end_id=1)


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(read_table(spark, sf_dir, "documents"), radius=11)


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read_table(spark, sf_dir, "documents"))


@query()
def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.pii_report(docs, pii.train_model(docs))


@query()
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), words=5, similarity=0.8)


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train_model(docs, read_table(spark, sf_dir, "labels")))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_wrap.extract_pages(pages, durable(html_wrap.induce_wrappers(pages), "wrappers"))


@query()
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(*vector_codes.train_codes(read_table(spark, sf_dir, "embeddings"), positions=8, entries=16, rounds=6))


@query()
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_trie.prefix_trie(conversation_trie.with_shared_openings(conversations, group=100, openings=6))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train_model(docs, read_table(spark, sf_dir, "labels")))
