"""Standing queries: replay, refusal, errors that go away, and changes that equal a recomputation."""

import random

import pytest

from plumbago.errors import LiveError, Refused
from plumbago.plans.dialect import parse
from plumbago.plans.ir import BIGINT, TEXT, Catalog, Field
from plumbago.plans.lower import WEIGHT, Lowering, consolidated
from plumbago.streaming.standing import Standing


def catalog():
    c = Catalog()
    c.declare("t", [Field("k", BIGINT), Field("v", BIGINT)])
    c.declare("u", [Field("k", BIGINT), Field("name", TEXT)])
    return c


def frame(spark, rows, text="k long, v long"):
    return spark.createDataFrame(rows, f"{text}, {WEIGHT} long")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT t.v AS v, u.name AS name FROM t JOIN u ON t.k = u.k WHERE t.v > 1",
        "SELECT DISTINCT t.v AS v FROM t JOIN u ON t.k = u.k",
        "SELECT u.name AS name, COUNT(*) AS n, SUM(t.v) AS s, AVG(t.v) AS a, MIN(t.v) AS lo FROM t JOIN u ON t.k = u.k GROUP BY u.name HAVING n > 1",
        "SELECT COUNT(v) AS n, MAX(v) AS hi FROM t",
    ],
)
def test_change_equals_recomputation(spark, text):
    rnd = random.Random(text)
    q, c = parse(text, catalog()), catalog()
    pick = lambda n: [(rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, 3, None]), 1) for _ in range(n)]
    names = lambda n: [(rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", None]), 1) for _ in range(n)]
    t0, u0 = pick(12), names(5)
    before = {"t": consolidated(frame(spark, t0)), "u": consolidated(frame(spark, u0, "k long, name string"))}
    moved = {"t": consolidated(frame(spark, [(*r[:2], -1) for r in t0[:4]] + pick(3))), "u": consolidated(frame(spark, [(*u0[0][:2], -1)] + names(2), "k long, name string"))}
    after = {n: consolidated(before[n].unionByName(moved[n])) for n in before}
    low = lambda: Lowering(q, c, weighted=True)
    old, new, delta = low().answer(before), low().answer(after), low().change(before, moved)
    assert content(consolidated(old.unionByName(delta))) == content(consolidated(new))


def test_log(spark):
    s = Standing(spark, catalog())
    s.register("q", "SELECT k AS k, 10 / v AS x FROM t")
    assert s.append("a", "t", frame(spark, [(1, 2, 1)]), token="one")
    assert not s.append("a", "t", frame(spark, [(1, 2, 1)]), token="one")
    with pytest.raises(Refused, match="TokenReused"):
        s.append("a", "t", frame(spark, [(1, 3, 1)]), token="one")
    s.seal()
    assert content(s.read("q")) == [(1, 5, 1)]
    s.append("b", "t", frame(spark, [(2, 0, 1)]))
    s.seal()
    with pytest.raises(LiveError, match="DivisionByZero"):
        s.read("q")
    s.retract_source("b")
    assert content(s.read("q")) == [(1, 5, 1)]
    s.append("a", "t", frame(spark, [(9, 9, -1)]))
    with pytest.raises(Refused, match="NegativeIntegral"):
        s.seal()
    assert content(s.changes("q", 0).select("k", "x", WEIGHT)) == [(1, 5, 1)]


def test_follows_a_stream(spark, tmp_path):
    s = Standing(spark, catalog(), str(tmp_path / "state"))
    s.register("q", "SELECT k AS k, SUM(v) AS v FROM t GROUP BY k")
    spark.range(6).selectExpr("id % 2 AS k", "id AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
    s.follow(stream, "files", "t", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert content(s.read("q").drop(WEIGHT)) == [(0, 6), (1, 9)]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT * FROM t", "SelectStarNotSupported"),
        ("SELECT k AS k FROM t ORDER BY k", "NotInDialect"),
        ("SELECT k AS k FROM t, u", "CrossJoinNotSupported"),
        ("SELECT t.k AS k FROM t LEFT JOIN u ON t.k = u.k", "JoinNotSupported"),
        ("SELECT k AS k FROM t WHERE k = 'a'", "TypeMismatch"),
        ("SELECT K AS k FROM t", "UnknownColumn"),
        ("SELECT k + 1 FROM t", "MissingOutputName"),
        ("SELECT k AS k FROM t WHERE v IN (1)", "NotInDialect"),
        ("SELECT v AS v, COUNT(*) AS n FROM t GROUP BY k", "ColumnNotGrouped"),
        ("SELECT k AS k FROM t WHERE v > 1.5", "FloatLiteralNotSupported"),
        ("SELECT upper(name) AS n FROM u", "UnknownFunction"),
        ("DELETE FROM t", "NotAQuery"),
        ("SELECT NULL AS x FROM t", "UntypedNullLiteral"),
    ],
)
def test_refusals(text, code):
    with pytest.raises(Refused) as e:
        parse(text, catalog())
    assert e.value.code == code


def test_failed_seal_loses_nothing(spark, monkeypatch):
    s = Standing(spark, catalog())
    s.register("q", "SELECT k AS k, v AS v FROM t")
    rows = frame(spark, [(1, 2, 1)])
    s.append("a", "t", rows, token="one")
    s.append("a", "t", frame(spark, [(8, 8, -1)]))
    with pytest.raises(Refused, match="NegativeIntegral"):
        s.seal()
    assert s.append("a", "t", rows, token="one")
    with monkeypatch.context() as m:
        m.setattr(Standing, "_commit", lambda *_, **__: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            s.seal()
    assert s.epoch == 0 and content(s.read("q")) == []
    assert s.append("a", "t", rows, token="one") and s.seal() == 1
    assert content(s.read("q")) == [(1, 2, 1)] and not s.append("a", "t", rows, token="one")


def test_reopens_from_its_folder(spark, tmp_path):
    s = Standing(spark, catalog(), str(tmp_path / "state"))
    s.register("q", "SELECT k AS k, 10 / v AS x FROM t")
    s.append("a", "t", frame(spark, [(1, 2, 1), (2, 0, 1)]), token="one")
    s.seal()
    again = Standing.open(spark, str(tmp_path / "state"))
    with pytest.raises(LiveError, match="DivisionByZero"):
        again.read("q")
    assert not again.append("a", "t", frame(spark, [(1, 2, 1), (2, 0, 1)]), token="one")
    again.append("b", "t", frame(spark, [(2, 0, -1), (3, 5, 2)]))
    again.seal()
    again.compact()
    third = Standing.open(spark, str(tmp_path / "state"))
    assert content(third.read("q")) == [(1, 5, 1), (3, 2, 2)] and third.epoch == 2
    assert content(third.integral("t")) == [(1, 2, 1), (3, 5, 2)]
    third.retract_source("b", "t", "v = 5")
    assert content(third.read("q")) == [(1, 5, 1)] and content(third.changes("q", 2).drop("__epoch")) == [(3, 2, -2)]
    with pytest.raises(Refused, match="SubscriptionGap"):
        third.epochs("t", 0)
    assert {(r.kind, r.name) for r in third.state().collect()} == {("table", "t"), ("table", "u"), ("answer", "q"), ("errors", "q")}


def test_equal_queries_are_kept_once(spark):
    s = Standing(spark, catalog())
    s.register("a", "SELECT t.v AS v FROM t JOIN u ON t.k = u.k")
    s.register("b", "SELECT t.v AS v FROM t JOIN u ON u.k = t.k")
    assert len(s.queries) == 1
    s.deregister("a")
    s.append("x", "t", frame(spark, [(1, 1, 1)]))
    s.append("x", "u", frame(spark, [(1, "n", 1)], "k long, name string"))
    s.seal()
    assert content(s.canonical("b")) == [(1, 1)]
    with pytest.raises(Refused, match="UnknownHandle"):
        s.read("a")


def test_errors_of_groups_come_and_go(spark):
    s = Standing(spark, catalog())
    s.register("q", "SELECT k AS k, SUM(v) AS s FROM t GROUP BY k")
    big = (1 << 63) - 1
    s.append("a", "t", frame(spark, [(1, big, 1), (1, 1, 1), (2, 3, 1)]))
    s.seal()
    with pytest.raises(LiveError, match="AggregateOverflow"):
        s.read("q")
    s.append("a", "t", frame(spark, [(1, 1, -1)]))
    s.seal()
    assert content(s.read("q")) == [(1, big, 1), (2, 3, 1)]
