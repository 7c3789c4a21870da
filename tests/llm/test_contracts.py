"""What the registered queries return, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

COLUMNS = {
    "op1_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op3_token_id_index": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_length_bucket_packing": {"doc_id": "bigint", "n_tokens": "bigint", "boundary": "bigint", "batch": "bigint"},
    "op9_paragraph_dedup": {"doc_id": "bigint", "start_word": "int", "n_words": "int", "removed": "boolean", "component_id": "bigint"},
    "op10_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}
ONE_ROW_EACH = [n for n in COLUMNS if n.split("_")[0] not in ("op4", "op8", "op9")]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = entry.queries()[name](spark, small)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    docs = [r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    if name in ONE_ROW_EACH:
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name.startswith("op8"):
        assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        for c in ("score", "near_edited", "near_next"):
            if c in kinds and kinds[c] == "double":
                assert 0 <= r[c] <= 1
    assert rows
