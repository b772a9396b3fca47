"""Event files, traces, commits, event SQL refusals and cursors."""

import json

import pytest

from plumbago.errors import Refused
from plumbago.operators import events as ev
from plumbago.operators import memory
from plumbago.plans import event_sql
from plumbago.sources import external


def test_tsv_round_trip(spark, tmp_path):
    rows = [("e1", "t", 5, "n", 1.5, True, "tab\there\nline \\t slash \\\\ \r"), ("e2", "t", -1, "n\\", 0.0, False, "")]
    df = spark.createDataFrame(rows, "event_id string, tenant_id string, event_time long, event_name string, cost double, error boolean, body string")
    external.write_tsv(df, str(tmp_path / "x"))
    assert sorted(map(tuple, external.read_tsv(spark, str(tmp_path / "x")).collect())) == sorted(rows)
    (tmp_path / "bad.tsv").write_text("\t".join(external.TSV) + "\none\ttwo\n")
    with pytest.raises(Exception, match="MalformedLine"):
        external.read_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    external.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_otlp(spark, tmp_path):
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    spans = [
        {"traceId": "t1", "spanId": "s1", "name": "chat", "startTimeUnixNano": "1760000000123456789", "status": {"code": 2}, "attributes": [text("gen_ai.prompt", "hi"), text("gen_ai.completion", "yo"), {"key": "gen_ai.usage.cost", "value": {"doubleValue": 0.5}}]},
        {"traceId": "t1", "spanId": "s2", "name": "empty", "startTimeUnixNano": "1", "attributes": []},
    ]
    doc = lambda s: json.dumps({"resourceSpans": [{"resource": {"attributes": [text("service.namespace", "ns")]}, "scopeSpans": [{"spans": s}]}]})
    (tmp_path / "a.json").write_text(doc(spans) + "\n")
    got = external.read_otlp(spark, str(tmp_path / "a.json")).collect()
    assert [(r.event_id, r.tenant_id, r.event_time, r.cost, r.error, r.body) for r in got] == [("s1", "ns", 1760000000123, 0.5, True, "hi\nyo")]
    (tmp_path / "b.json").write_text(doc([spans[0] | {"spanId": ""}]) + "\n")
    with pytest.raises(Exception, match="MissingSpanId"):
        external.read_otlp(spark, str(tmp_path / "b.json")).collect()


def test_commits_in_sequence(spark):
    seq = lambda *n: spark.createDataFrame([(x,) for x in n], "seq long")
    assert sorted(r.seq for r in external.next_commits(seq(1, 2, 3, 4), seq(1, 2)).collect()) == [3, 4]
    assert external.next_commits(seq(1), seq(1)).count() == 0
    with pytest.raises(Refused, match="SequenceGap"):
        external.next_commits(seq(4), seq(1, 2))


def test_generated_corpus_is_fixed(spark):
    a, b = (external.generated(spark, 200).repartition(n).collect() for n in (1, 5))
    assert sorted(a) == sorted(b) and len({r.event_name for r in a}) > 3


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT event_id FROM t", "UnknownTable"),
        ("SELECT event_id FROM events JOIN events", "JoinNotSupported"),
        ("SELECT event_id FROM events ORDER BY cost", "OrderNotSupported"),
        ("SELECT event_id FROM events LIMIT 5 OFFSET 5", "OffsetNotSupported"),
        ("SELECT event_id FROM events WHERE error OR embedding ≈≈ 'x'", "SimilarityNotTopLevel"),
        ("SELECT event_id FROM events WHERE embedding ≈≈ 'x' AND embedding ≈≈ 'y'", "OneSimilarityOnly"),
        ("SELECT nothing FROM events", "UnknownColumn"),
        ("SELECT sum(body) AS s FROM events", "TypeMismatch"),
        ("SELECT event_id, count(*) AS n FROM events", "ColumnNotGrouped"),
        ("SELECT event_id FROM events WHERE cost IN (" + ", ".join(map(str, range(1025))) + ")", "InListTooLong"),
        ("SELECT event_id FROM events WITH (speed = 3)", "UnknownControl"),
        ("SELECT event_id FROM events WHERE " + "NOT " * 40 + "error", "TooDeep"),
    ],
)
def test_event_sql_refusals(text, code):
    with pytest.raises(Refused) as e:
        event_sql.parse(text)
    assert e.value.code == code


def test_cursors_bind_plan_and_snapshot():
    plan, other = event_sql.parse("SELECT event_id FROM events"), event_sql.parse("SELECT event_id FROM events WHERE error")
    token = event_sql.cursor(plan, "v1", 0.5, 7)
    assert event_sql.after(plan, "v1", token) == (0.5, 7)
    for args, code in (((other, "v1", token), "CursorOfAnotherPlan"), ((plan, "v2", token), "SnapshotReclaimed"), ((plan, "v1", "AAAA" + token[4:]), "CursorDamaged")):
        with pytest.raises(Refused, match=code):
            event_sql.after(*args)
    assert event_sql.day_range(event_sql.parse("SELECT event_id FROM events WHERE event_time >= 86400001 AND error AND event_time < 259200000").where) == (86400000, 259200000)


def test_three_values(spark):
    df = spark.createDataFrame([(1, True, '{"a": 1}'), (2, False, '{"a": "1"}'), (3, True, "{}")], "event_id long, error boolean, props string").selectExpr("*", "parse_json(props) AS attributes")
    ids = lambda w: [r.event_id for r in event_sql.run(df, f"SELECT event_id FROM events WHERE {w}").collect()]
    assert ids("attributes['a'] = 1") == [1] and ids("attributes['a'] = '1'") == [2] and ids("NOT attributes['a'] = 1") == []
    assert ids("attributes['a'] IN (1, '1')") == [1, 2] and ids("NOT attributes['a'] IN (5)") == [1, 2]
    assert ids("error AND event_id = 1 OR event_id = 2") == [1, 2]


def test_merge_policies_and_packing(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v array<int>")
    base, source, target = rows(("a", [1]), ("b", [1]), ("c", [1]), ("d", [1])), rows(("a", [1, 2]), ("b", [1]), ("c", [2])), rows(("a", [1, 3]), ("b", [4]), ("d", [1]))
    out = {r.k: (r.v, r.how) for r in memory.merge_sets(base, source, target, "k", "v").collect()}
    assert out == {"a": ([1, 2, 3], "both"), "b": ([4], "target"), "c": (None, "conflict"), "d": ([1], "target")}
    assert {r.k: r.v for r in memory.merge_sets(base, source, target, "k", "v", "take_source").collect()}["a"] == [1, 2]
    with pytest.raises(Refused, match="UnknownPolicy"):
        memory.merge_sets(base, source, target, "k", "v", "best")
    items = spark.createDataFrame([("a", 9.0, 5), ("b", 8.0, 6), ("c", 7.0, 4), ("d", 6.0, 1)], "key string, score double, cost int")
    assert [r.key for r in memory.packed(items, 10).orderBy("place").collect()] == ["a", "c", "d"]
    log = spark.createDataFrame([("x", "p", 1, "fork", 0), ("x", "q", 2, "fork", 1)], "child string, parent string, at_epoch long, kind string, seq long")
    with pytest.raises(Exception, match="SecondFork"):
        memory.lineage(log).collect()


def test_routes_follow_the_tenant(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "tenant_id string, n int")
    got = {r.n: r.shard for r in ev.routed(df, 4).collect()}
    assert got[1] == got[3] and all(0 <= x < 4 for x in got.values())


def test_packing_many_entries(spark):
    """More than the 100,000 entries that were refused once; repeated keys, a frequent cost and missing scores."""
    rows = [(k % 159_999, None if k % 11 == 3 else float(k * 7919 % 997), 1 if k % 3 == 0 else k % 400) for k in range(160_000)]
    left, want = 300, []
    for k, s, c in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0], r[2])):
        if 0 < c <= left:
            left -= c
            want.append((k, s, c))
    items = spark.createDataFrame(rows, "key long, score double, cost int").repartition(5)
    got = memory.packed(items, 300).orderBy("place").collect()
    assert [tuple(r)[:3] for r in got] == want and [r.place for r in got] == list(range(len(want)))
    few = spark.createDataFrame([(1, None, 6), (2, 1.0, 5), (None, 9.0, 4), (3, 0.5, 1)], "key long, score double, cost int")
    assert [(r.key, r.place) for r in memory.packed(few, 10).orderBy("place").collect()] == [(2, 1), (3, 2)]
