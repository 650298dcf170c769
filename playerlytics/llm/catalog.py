"""Registered queries of the subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, edited, langid, licenses, lines, packing, pieces, pii, secrets, simhash, spans, topk, urls, whitening
from .tables import importable, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_exact_topk(spark, sf_dir):
    """Ten highest integer inner products of every hundredth vector against all others."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query
def op2_document_fingerprints(spark, sf_dir):
    """Bottom-256 sketches of five-word shingles, of the texts and of the edited texts."""
    found = edited.fingerprints_beside(read(spark, sf_dir, "documents"), shingle=5, k=256)
    return found.select("doc_id", "n_chars", "edited_sha256", F.base64("sketch").alias("fingerprint"),
                        F.base64("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op3_simhash_near_dedup(spark, sf_dir):
    """Three-word shingles, links at three differing bits or fewer."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The given rules of op4: verdict, then host and path prefix.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op4_url_filter(spark, sf_dir):
    """Given rules first; rules mined from the urls that they decide judge the others."""
    found = urls.judge(read(spark, sf_dir, "pages"), URL_RULES, min_support=0.002, min_confidence=0.8)
    return found.select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")


@query
def op5_sentencepiece(spark, sf_dir):
    """Ids of the 32k BPE model for every whole text, and the hash of what they decode to."""
    found = pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", "round_trip")


@query
def op6_license_scan(spark, sf_dir):
    """Base phrases and all signature rules, overlapping detections resolved by priority."""
    return licenses.summary(licenses.scan_licenses(read(spark, sf_dir, "documents")))


@query
def op7_secret_scan(spark, sf_dir):
    """Base kinds by pattern; keys and signed tokens as far as their structure confirms them."""
    return spans.digest(secrets.scan_secrets(read(spark, sf_dir, "documents")), secrets.BASE)


@query
def op8_personal_data(spark, sf_dir):
    """Direct identifiers, and terms of their documents that reveal 0.8 of their information or more."""
    found = pii.scan_personal_data(read(spark, sf_dir, "documents"), threshold=0.8)
    return spans.digest(found, pii.BASE)


@query
def op9_language_id(spark, sf_dir):
    """Text, declared language (lang) and host (source) of every document; rejected ones are marked."""
    found = langid.identify(read(spark, sf_dir, "documents"), per_language=2000)
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted")


@query
def op10_packing(spark, sf_dir):
    """Sequences of 2048 ids of the word tokenizer, id 1 after each document."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, end_id=1)


@query
def op11_line_dedup(spark, sf_dir):
    """Lines of 40 code points or more in five documents or more stay in the largest doc_id only."""
    found = lines.without_repeated_lines(read(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_collocations(spark, sf_dir):
    """The 2000 best phrases of two to five words of each language, by their weakest cut."""
    return collocations.collocations(read(spark, sf_dir, "documents"), least=100, top=2000)


@query
def op13_embedding_whitening(spark, sf_dir):
    """Sixteen components of the distinct vectors; every usable vector projected and scaled to unit variance."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)
