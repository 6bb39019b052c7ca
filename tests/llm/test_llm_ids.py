"""Ids beyond 2**53, negative ones and null in one batch come out of every operator as they went in."""

from __future__ import annotations

import public_tokenizers as P
import pytest

from bitvane.llm import byte_bpe, fingerprint, near_dedup, packing, token_counts, warc

A, B, C = 2**53 + 1, 2**53 + 3, -1
STORY = "the ferry left the harbour at dawn and nobody on the pier saw who had cast off its ropes before the bell rang for the first time that week"
ROWS = [(A, STORY), (B, STORY + " again"), (None, "another text of quite other words than those before"), (C, "a third text that shares nothing with the first one")]
IDS = {A, B, C, None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1).persist()


def _ids(df, name="doc_id"):
    return [r[name] for r in df.collect()]


def test_packing_keeps_ids(docs):
    assert set(_ids(packing.pack(docs, P.path("word_bpe_49k.json")))) == IDS


def test_fingerprints_keep_ids(docs):
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).collect()}
    assert set(got) == IDS
    assert got[A]["near_next"] > 0.8 and {i: r["n_chars"] for i, r in got.items()} == {i: len(t) for i, t in ROWS}
    runs = {r["doc_id"] for r in fingerprint.edited_pairs(docs, run_rows=1).collect()}
    assert runs == IDS


def test_byte_bpe_keeps_ids(docs):
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert set(_ids(byte_bpe.digests(docs, ranks, P.PATTERN))) == IDS


def test_near_copies_are_found_beside_a_null_id(docs):
    classes = {r["doc_id"]: (r["class_id"], r["class_size"], r["links"]) for r in near_dedup.near_classes(docs).collect()}
    assert set(classes) == IDS and classes[A] == classes[B] == (A, 2, 1) and classes[C] == (C, 1, 0)
    assert set(_ids(near_dedup.near_dedup(docs))) == {A, None, C}


def test_counts_reach_the_ids(spark, docs, tmp_path):
    rows = docs.selectExpr("doc_id", "'web' AS source", "'en' AS lang", "text")
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    by = {"v": token_counts.BpeCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)}
    ledger.insert("one", rows, by)
    assert ledger.totals().collect()[0]["docs"] == 4
    ledger.delete("two", spark.createDataFrame([(A,)], "doc_id bigint"))
    assert ledger.totals().collect()[0]["docs"] == 3
    ledger.delete("three", spark.createDataFrame([(B,), (C,)], "doc_id bigint"))
    assert ledger.totals().collect()[0]["docs"] == 1


def test_records_are_the_same_beside_a_null_id(spark):
    pages = [(A, "http://a.example/", "<p>one</p>"), (B, None, None), (3, "http://c.example/", "<p>three</p>"), (None, "http://d.example/", "<p>four</p>")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    every = {r["page_id"]: r["record_id"] for r in warc.responses(table, "2024-01-01T00:00:00Z").collect()}
    known = {r["page_id"]: r["record_id"] for r in warc.responses(table.where("page_id IS NOT NULL"), "2024-01-01T00:00:00Z").collect()}
    assert set(every) == {A, B, 3, None} and {k: v for k, v in every.items() if k is not None} == known
    made = warc.derive(warc.responses(table, "2024-01-01T00:00:00Z")).collect()
    assert {r["page_id"] for r in made} == set(every) and {r["refers_to"] for r in made} == set(every.values())
