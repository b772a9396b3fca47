import random

from plumbago.llm import queries, quality_rules, sql
from tests.llm import brute, oracle

SF = "/root/testdata/sf0.001"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    w, t = brute.words(text), text or ""
    lines = [x for x in t.split("\n") if brute.words(x)]
    seen, covered = {}, set()
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            covered |= {k + d for k in at for d in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_matches_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert oracle.spark_rows(queries.op1_quality_rules(spark, sf)) == oracle.duck(sql.QUALITY_RULES, sf)


def test_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", " \t\r\n", "é\u00a0ü ö\n\né\u00a0ü ö", "a\x0bb\x0cc\td", "# * $ % & | < > ##", "x y " * 4000, "one\n\none\n \none "]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, bucket int")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in quality_rules.measures(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}
    ruled = quality_rules.apply_rules(df).collect()
    assert len(ruled) == len(texts) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in ruled)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_thresholds_follow_the_source(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(80))
    rows = [(i, prose(), "en", "plain") for i in range(100)] + [(i, prose().replace(" ", " | "), "en", "tables") for i in range(100, 200)] + [(200, prose().replace(" ", " | "), "en", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()}
    assert not kept.pop(200) and sum(kept.values()) >= 198


def test_native(spark):
    plan = quality_rules.measures(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_limits_differ_between_groups_and_lean_on_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sketch = quality_rules.sketches(quality_rules.with_ratios(quality_rules.measures(docs)).where("not base_failed"))
    limits = quality_rules.thresholds(sketch).collect()
    for ratio in quality_rules.RATIOS:
        assert len({tuple(r.t[ratio]) for r in limits}) > 2, ratio
    prose = "one two three four five six seven eight nine ten eleven twelve {}"
    rows = [(i, prose.format("x"), "en", "large") for i in range(1000)] + [(i, prose.format("x #a #b #c #d #e #f"), None, None) for i in range(1000, 1002)] + [(i, prose.format("#a #b #c #d #e #f"), "en", "small") for i in range(2000, 2003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = {(r.t_lang, r.t_source): r.t.symbols[1] for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.with_ratios(quality_rules.measures(df)).where("not base_failed"))).collect()}
    own = t["en", "small"] * 13 / 3
    assert t["en", "large"] < 1 and 300 < own < 600 and 0 < t[None, None] < 300
    assert quality_rules.apply_rules(df).where("doc_id >= 1000").count() == 5


def test_whole_query_is_native(spark):
    plan = queries.op1_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
