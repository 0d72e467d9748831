"""Some registered queries against their SQL twins in DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "benchmark", "labels", "events", "orders", "customer")
NAMES = ("p3_extract_turns", "p7_row_tokens", "f3_token_range", "jn2_leakage_exact", "jn6_key_delta", "a4_summarize_tokens", "a5_bucketize_tokens", "a12_pii_counts", "dd1_exact_dedup", "l4_validate_schema", "t2_openai_to_sharegpt", "sp2_split_stratified", "an1_annotation_state", "p2_detect_format", "p8_row_chunks", "l1_lint_rows", "pi5_pii_by_field", "pi8_redact_all", "j1_explode_nodes", "j9_diff_json", "c1_simhash64", "dd2_near_dedup", "jn4_leakage", "s3_read_auto", "s11_write_audit_report", "an2_tags_in_order", "h1_versions_of_texts", "h2_stale_and_refreshed", "st3_running_audit", "s1_places", "s8_array_read_back", "sp3_sample", "t6_regex_replace", "pi4_redact_json")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(found.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in found.select(*cols).collect()]
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want)))


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
