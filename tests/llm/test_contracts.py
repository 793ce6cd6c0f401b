"""Each registered query over a small table: its columns, its rows, and what its contract fixes."""

import hashlib
import zlib

import pytest

from dwell.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, *columns):
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.columns[: len(columns)] == list(columns) or set(columns) <= set(found.columns), name
    return found.collect()


def test_classes_and_languages(spark, documents):
    rows = rows_of(spark, "op1_simhash_near_dedup", "doc_id", "fingerprint", "component_id")
    assert {r.doc_id for r in rows} == set(documents) and all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)
    rows = rows_of(spark, "op2_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id] or ""))


def test_repeats_and_addresses(spark, documents):
    rows = rows_of(spark, "op4_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        words = (documents[r.doc_id] or "").encode().split()
        assert r.n_words == len(words) and 0 <= r.n_removed <= r.n_words
        assert r.n_removed or r.kept_sha256 == hashlib.sha256(b" ".join(words)).hexdigest()
    rows = rows_of(spark, "op7_url_filters", "page_id", "host", "path", "rule", "verdict")
    assert len(rows) == spark.read.parquet(f"{FOLDER}/pages.parquet").count() and {r.verdict for r in rows} <= {"allow", "block"}
    rows = rows_of(spark, "op5_line_dedup", "doc_id", "n_lines", "n_removed", "text")
    assert {r.doc_id for r in rows} == set(documents)


def test_fingerprints_and_leaks(spark, documents):
    rows = rows_of(spark, "op8_document_fingerprints", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(documents, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        text, after = documents[r.doc_id] or "", documents[following[r.doc_id]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    assert all(prints.setdefault(documents[r.doc_id] or "", r.fingerprint) == r.fingerprint for r in rows)
    rows = rows_of(spark, "op3_decontamination", "doc_id", "item_id", "similarity")
    assert all(r.similarity >= 0.8 and r.doc_id in documents for r in rows)


def test_counts_packs_and_toxicity(spark, documents):
    rows = rows_of(spark, "op6_token_counts", "n_tokens", "n_docs", "docs_from")
    assert sum(r.n_docs for r in rows) == len(documents)
    pieces = rows_of(spark, "op9_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert {r.doc_id for r in pieces} == set(documents)
    by = {}
    for r in pieces:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert all(by[r.doc_id] == r.doc_tokens for r in pieces)
    assert sum(r.n_docs * (r.n_tokens + 1) for r in rows) == sum(r.length for r in pieces)
    rows = rows_of(spark, "op10_toxicity", "doc_id", "held_out", "score", "predicted")
    assert {r.doc_id for r in rows} == set(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
