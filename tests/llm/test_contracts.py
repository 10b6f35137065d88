"""The registered queries: columns, types and a row for each document."""

import hashlib

import pytest

import __spark_entry__ as entry

LONG = "bigint"
COLUMNS = {
    "op2_secrets": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": "string", "spans": "string"},
    "op3_minhash": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG, "kept": "boolean"},
    "op7_token_files": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op8_pii": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": "string", "spans": "string"},
    "op10_byte_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, name):
    found = entry.queries()[name](spark, sf)
    assert {c: t for c, t in found.dtypes if c in COLUMNS[name]} == COLUMNS[name]
    rows = found.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {r.doc_id: r for r in rows}
    if name == "op3_minhash":
        assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.doc_id for r in rows)
        assert all(by[r.component_id].component_id == r.component_id for r in rows)
    if name == "op7_token_files":
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens >= 1) == (at, True)
            at += r.n_tokens
    if name == "op10_byte_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)
    if name in ("op2_secrets", "op8_pii"):
        counts = [c for c in COLUMNS[name] if c.startswith("n_")]
        for r in rows:
            spans = [x.split(":") for x in r.spans.split(",") if x]
            starts = [int(a) for _, a, _ in spans]
            assert starts == sorted(starts)
            assert all(0 <= int(a) < int(b) <= len(docs[r.doc_id]) for _, a, b in spans)
            # base spans are among all spans
            for c in counts:
                assert sum(k == c[2:] for k, _, _ in spans) >= r[c]
