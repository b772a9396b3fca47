"""Events from tab-separated files and OTLP traces, a JSON-lines sink, and the capture of commits as epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.errors import Refused

#: The header of a tab-separated event file.
TSV = ("event_id", "tenant_id", "event_time", "event_name", "cost", "error", "body")


def _unescaped(c: Column) -> Column:
    """Backslash escapes of tab, line end, return and backslash, each read once."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def _escaped(c: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Events of a tab-separated file with the fixed header; a line of other width, or a bad number, fails the job."""
    lines = spark.read.text(path).where("value <> ''")
    header = "\t".join(TSV)
    rows = lines.where(F.col("value") != header).select(F.split("value", "\t", -1).alias("f"))
    checked = rows.where(F.when(F.size("f") != len(TSV), F.raise_error(F.lit("MalformedLine")).cast("boolean")).otherwise(True))
    text = {c: F.get("f", F.lit(k)) for k, c in enumerate(TSV)}
    return checked.select(
        *[_unescaped(text[c]).alias(c) for c in ("event_id", "tenant_id")],
        text["event_time"].cast("long").alias("event_time"),
        _unescaped(text["event_name"]).alias("event_name"),
        text["cost"].cast("double").alias("cost"),
        (text["error"] == "1").alias("error"),
        _unescaped(text["body"]).alias("body"),
    )


def write_tsv(events: DataFrame, path: str) -> None:
    """The inverse of read_tsv; each part file begins with no header, which the reader does not need."""
    cells = [F.coalesce(F.when(F.col(c), "1").otherwise("0") if c == "error" else _escaped(F.col(c).cast("string")), F.lit("")) for c in TSV]
    events.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)


def write_jsonl(events: DataFrame, path: str) -> None:
    events.write.json(path)


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_SPAN = f"struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"


def _attribute(attributes: Column, *names: str) -> Column:
    """The first of these attributes that is there, as text."""

    def one(name: str) -> Column:
        v = F.get(F.filter(attributes, lambda a: a["key"] == name), F.lit(0))["value"]
        return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))

    return F.coalesce(*[one(n) for n in names])


def read_otlp(spark: SparkSession, path: str, prompt: str = "gen_ai.prompt", completion: str = "gen_ai.completion", cost: str = "gen_ai.usage.cost") -> DataFrame:
    """Events from OTLP JSON, one export a line: a span with a prompt or completion is an event, others are skipped.

    The tenant is tenant.id or service.namespace; status code 2 is an error; a span without an id fails the job.
    """
    spans = spark.read.schema(OTLP).json(path).select(F.explode("resourceSpans").alias("r"))
    spans = spans.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.explode("s.spans").alias("x"))
    a = F.col("x.attributes")
    body = F.concat_ws("\n", _attribute(a, prompt), _attribute(a, completion))
    named = F.when(F.col("x.spanId").isNull() | (F.col("x.spanId") == ""), F.raise_error(F.lit("MissingSpanId")).cast("string")).otherwise(F.col("x.spanId"))
    rows = spans.where(body != "").select(
        named.alias("event_id"),
        _attribute(F.col("ra"), "tenant.id", "service.namespace").alias("tenant_id"),
        F.expr("cast(x.startTimeUnixNano as bigint) div 1000000").alias("event_time"),
        F.col("x.name").alias("event_name"),
        F.coalesce(_attribute(a, cost).cast("double"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.col("x.status.code") == 2, F.lit(False)).alias("error"),
        body.alias("body"),
        F.col("x.traceId").alias("trace_id"),
    )
    return rows


def derivations(commit: DataFrame, key: str = "row_key", sources: str = "sources") -> DataFrame:
    """One row for each row of a commit and each source it cites, (tenant, branch, table_name, row_key, source_system, source_record)."""
    cited = commit.select("tenant", "branch", "table_name", F.col(key).alias("row_key"), F.explode(sources).alias("s"))
    return cited.select("tenant", "branch", "table_name", "row_key", F.col("s.system").alias("source_system"), F.col("s.record").alias("source_record")).distinct()


def next_commits(commits: DataFrame, captured: DataFrame) -> DataFrame:
    """The commits (seq) not captured yet, in order; a gap between what was captured and them is refused."""
    done = captured.agg(F.max("seq")).first()[0] or 0
    new = commits.where(F.col("seq") > done)
    first, last, n = new.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
    if n and (first != done + 1 or last - first + 1 != n):
        raise Refused("SequenceGap", f"{done} to {first}, {n} of {last - first + 1}")
    return new


def generated(spark: SparkSession, n: int, tenants: int = 8, topics: int = 8, seed: int = 1) -> DataFrame:
    """A corpus of n events by hashes alone: tenants and topics of falling frequency, bodies of five words from their topic."""
    u = lambda what: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), "id"), 11) / float(1 << 53)
    skewed = lambda what, m: F.floor(F.pow(F.lit(float(m + 1)), u(what)) - 1).cast("long")
    rows = spark.range(n).withColumns({"tenant": skewed("tenant", tenants), "topic": skewed("topic", topics)})
    word = lambda k: F.concat(F.lit("w"), F.col("topic").cast("string"), F.lit("x"), F.floor(6 * u(f"word{k}")).cast("string"))
    return rows.select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("event_id"),
        F.concat(F.lit("t"), F.col("tenant").cast("string")).alias("tenant_id"),
        (F.lit(1_760_000_000_000) + 1000 * F.col("id")).alias("event_time"),
        F.concat(F.lit("topic"), F.col("topic").cast("string")).alias("event_name"),
        F.round(u("cost") * 10, 4).alias("cost"),
        (u("error") < 0.1).alias("error"),
        F.concat_ws(" ", *[word(k) for k in range(5)]).alias("body"),
    )
