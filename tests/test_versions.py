"""Versions of rows, audits that are kept up, and the audit of a stream, against the state and the audit made anew."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import features
from quarry.operators import annotate, audit, upkeep
from quarry.operators.versions import RowStore
from quarry.streaming.ingest import running_audit, running_counters, stream_read_jsonl

TEXTS = ['{"text":"one two three four five six"}', '{"text":"one two three four five six"}', '{"messages":[{"role":"user","content":"mail me@x.org"}]}', "{bad", '{"a":1}', '{"a":1}']


def table(spark, texts=TEXTS):
    return features.rows_table(spark.createDataFrame(list(enumerate(texts)), "row_id long, raw string"))


def plain(df):
    return {r.row_id: (r.raw, r.review, r.excluded, r.deleted, r.dirty, r.tags) for r in df.collect()}


def test_tags_are_replayed_in_order(spark):
    """add a, add b, remove a, add a gives b, a; a toggle looks at the row; a tag that is on stays where it is."""
    rows = table(spark)
    log = None
    for seq, (field, value) in enumerate([("tag+", "a"), ("tag+", "b"), ("tag-", "a"), ("tag+", "a"), ("tag+", "b"), ("tag-", "none")]):
        part = annotate.change(rows.where("row_id < 2"), seq, field, value)
        log = part if log is None else log.unionByName(part)
    now = annotate.state(rows, log)
    assert {r.row_id: r.tags for r in now.collect()} == {0: ["b", "a"], 1: ["b", "a"], 2: [], 3: [], 4: [], 5: []}
    assert {r.row_id: r.tags for r in annotate.state(rows, log, 2).collect()}[0] == ["b"]
    toggled = annotate.state(rows, log.unionByName(annotate.toggle_tag(now.where("row_id in (0, 4)"), 9, "b")))
    assert {r.row_id: r.tags for r in toggled.collect()} == {0: ["a"], 1: ["b", "a"], 2: [], 3: [], 4: ["b"], 5: []}


def test_state_applies_texts(spark):
    rows = table(spark)
    log = annotate.change(rows.where("row_id = 4"), 1, "raw", '{"text":"new"}').unionByName(annotate.change(rows.where("row_id = 4"), 2, "raw", "[2"))
    one = annotate.state(rows, log, 1).where("row_id = 4").first()
    assert (one.raw, one.json, one.fmt, one.error, one.dirty) == ('{"text":"new"}', '{"text":"new"}', "text", False, True)
    two = annotate.state(rows, log).where("row_id = 4").first()
    assert (two.raw, two.json, two.fmt, two.error) == ("[2", None, "parse-error", True)


def test_versions_and_undo(spark, tmp_path):
    rows = table(spark)
    store = RowStore.create(rows, str(tmp_path / "s"))
    seen = {0: plain(store.stored())}
    steps = [("raw", '{"text":"v1"}', "row_id < 3"), ("tag+", "x", "row_id > 1"), ("review", "approve", "true"), ("raw", '{"text":"v4"}', "row_id = 2"), ("deleted", "true", "row_id = 5")]
    for field, value, where in steps:
        version = store.apply(annotate.change(rows.where(where), 0, field, value))
        seen[version] = plain(store.stored())
    assert store.versions() == [0, 1, 2, 3, 4, 5] and all(plain(store.stored(v)) == seen[v] for v in seen)
    assert seen[1][0][0] == '{"text":"v1"}' and seen[4][2][0] == '{"text":"v4"}' and seen[5][5][3]
    assert store.undo(2) == 3 and plain(store.stored()) == seen[3] and store.rows().where("row_id = 2").first().json == '{"text":"v1"}'
    # what was undone is out of force; the next operation has a number of its own
    assert store.apply(annotate.change(rows.where("row_id = 0"), 0, "raw", "5")) == 6 and store.versions() == [0, 1, 2, 3, 6]
    with pytest.raises(ValueError):
        store.stored(4)
    again = RowStore(spark, str(tmp_path / "s"))
    assert again.version == 6 and {r.row_id for r in again.changed(2).collect()} == {0, 1, 2, 3, 4, 5} and {r.row_id for r in again.changed(3).collect()} == {0}


def test_old_deltas_are_folded(spark, tmp_path):
    rows = table(spark)
    store = RowStore.create(rows, str(tmp_path / "s"), slack=2)
    for k in range(14):
        store.apply(annotate.change(rows.where(f"row_id = {k % 3}"), 0, "raw", json.dumps({"text": f"v{k}"})), annotate.change(rows.where("row_id = 0"), 0, "tag+", f"t{k}"))
    assert store.versions() == [3, *range(4, 15)]
    now = plain(store.stored())
    assert [now[i][0] for i in range(3)] == ['{"text": "v12"}', '{"text": "v13"}', '{"text": "v11"}'] and now[0][5] == [f"t{k}" for k in range(14)]
    assert store.undo(99) == 4 and plain(store.stored())[0][5] == ["t0", "t1", "t2", "t3"]
    assert len(list((tmp_path / "s").glob("delta-*"))) == 11 and len(list((tmp_path / "s").glob("base-*"))) == 1


def test_a_failed_operation_leaves_the_version_before(spark, tmp_path):
    rows = table(spark)
    store = RowStore.create(rows, str(tmp_path / "s"))
    before = plain(store.stored())
    with pytest.raises(Exception):
        store.apply(annotate.change(rows, 0, "raw", F.raise_error(F.lit("lost")).cast("string")))
    assert store.version == 0 and plain(store.stored()) == before


def test_replaced_and_added_rows(spark):
    rows = table(spark)
    edits = spark.createDataFrame([(1, "[3]", 1), (1, "[1]", 2), (2, "{no", 3), (2, "7", 1)], "row_id long, raw string, seq long")
    got = {r.row_id: (r.raw, r.dirty) for r in annotate.replace_rows(rows, edits).collect()}
    assert len(got) == 6 and got[1] == ("[1]", True) and got[2] == ("7", True) and not got[0][1]
    new = spark.createDataFrame([("z",), ("a",), ("m",)], "raw string").coalesce(1)
    assert [(r.row_id, r.raw) for r in annotate.add_rows(rows, new).where("row_id > 5").orderBy("row_id").collect()] == [(6, "z"), (7, "a"), (8, "m")]
    placed = spark.createDataFrame([("z", 3), ("a", 1), ("m", 2)], "raw string, seq long")
    assert [r.raw for r in annotate.add_rows(rows, placed).where("row_id > 5").orderBy("row_id").collect()] == ["a", "m", "z"]


def same_audit(view, rows):
    want = audit.audit(rows)
    a, b = view.summary().first().asDict(), want["summary"].first().asDict()
    assert {k: a[k] for k in b} == b
    assert view.tokens().first().asDict() == want["tokens"].first().asDict()


def test_audit_is_kept_up(spark, tmp_path):
    """Edits, deletions, new rows and a row put back: the refreshed audit is that of all rows."""
    rows = table(spark)
    store = RowStore.create(rows, str(tmp_path / "s"))
    view = upkeep.AuditView.create(store.rows(), str(tmp_path / "v"), store.version)
    same_audit(view, store.rows())
    for field, value, where in [("raw", '{"text":"a@b.org and more words here now"}', "row_id in (1, 4)"), ("deleted", "true", "row_id = 5"), ("raw", '{"a":1}', "row_id in (1, 3)"), ("deleted", "false", "row_id = 5"), ("deleted", "true", "true")]:
        before = store.version
        store.apply(annotate.change(rows.where(where), 0, field, value))
        assert view.of == before < store.version
        changed = store.changed(before)
        view.refresh(store.rows().join(changed, "row_id", "left_semi"), store.version)
        assert view.of == store.version
        same_audit(view, store.rows())
    view.compact()
    same_audit(view, store.rows())
    assert view.summary().first().total == 0


def test_a_refresh_reads_changed_rows_only(spark, tmp_path):
    """The text of no other row is asked for: it would fail."""
    rows = table(spark)
    view = upkeep.AuditView.create(rows, str(tmp_path / "v"))
    changed = features.rows_table(spark.createDataFrame([(4, '{"a":2}')], "row_id long, raw string"))
    view.refresh(changed)
    same_audit(view, table(spark, [*TEXTS[:4], '{"a":2}', TEXTS[5]]))
    assert spark.read.parquet(str(tmp_path / "v" / "rows" / "00000001")).count() == 1


def test_stale_audits(spark, tmp_path):
    rows = table(spark)
    audit.save_audit(audit.audit(rows), rows, str(tmp_path))
    status = lambda r: tuple(audit.audit_status(r, str(tmp_path)).first())
    assert status(rows) == (True, False) and audit.load_audit(rows, str(tmp_path))["status"].first().stale is False
    edited = table(spark, [*TEXTS[:5], '{"a":2}'])
    assert status(edited) == (True, True) and audit.load_audit(edited, str(tmp_path))["status"].first().stale
    fewer = rows.where("row_id > 0")
    assert status(fewer) == (False, True) and audit.load_audit(fewer, str(tmp_path)) is None
    assert status(rows.where("row_id < 0"))[1]


def test_stream_counts_across_batches_and_restarts(spark, tmp_path):
    """Files that arrive one after the other, each run a new start: the summary is that of all rows."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    lines = []
    for k, part in enumerate((TEXTS[:3], TEXTS[2:5], [], TEXTS[:1] + ['{"text":"me@x.org is here for all of you"}'], TEXTS)):
        (source / f"{k}.jsonl").write_text("\n".join(part) + "\n")
        lines += part
        running_audit(stream_read_jsonl(spark, str(source)), out, checkpoint).awaitTermination()
    want = audit.audit(table(spark, lines))["summary"].first().asDict()
    got = upkeep.summary(running_counters(spark, out)).first().asDict()
    assert {k: got[k] for k in want} == want and want["dup_rows"] > 4
