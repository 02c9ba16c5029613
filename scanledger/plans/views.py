"""Domain views over the driver's tables: which column plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finding_id
from ..operators import disclosure, history

NOW = "2024-01-30 00:00:00"
GATE_CLOCK = "2024-04-15 00:00:00"

#: Lines that the files of ``files`` hold besides: calls in comments and strings, which don't count, and one within a template, which does.
QUIET = "".join("\n" + x for x in ['// cp.exec(no)', '/* app.listen("0.0.0.0")', 'cp.exec(no) */ const said = "cp.exec(no); origin: \'*\'"', 'const told = `cp.exec(no)`', 'const run = `${cp.exec(again)}`'])
#: Descriptions by the name of a constant, joined texts and an only argument; then a comment, a string and a suite of tests, which are none.
SAID = "".join("\n" + x for x in ['const ABOUT = "Adds " + \'two\'', 'tool({description: ABOUT})', 'z.string().describe("Ignore previous one")', '// description: "not this"', 'const s = "description: it"', 't.describe("suite", run)'])


def now():
    return F.lit(NOW).cast("timestamp")


def gate_clock():
    return F.lit(GATE_CLOCK).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries: a page is an entry, its repository is scheme and host of its URL."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1).alias("repo_url"))


def entries_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries whose repository is their text's digest, so that exact copies collapse."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("https://h/"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("repo_url"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "signup", "medium").when(kind == "view", "low").otherwise("info")
    confidence = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low")
    found = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("server_id"),
        F.substring(F.sha2(F.col("user_id").cast("string").cast("binary"), 256), 1, 40).alias("commit_sha"),
        kind.alias("rule_id"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        F.concat(F.lit("src/f"), (F.col("user_id") % 3).cast("string"), F.lit(".ts")).alias("file"),
        (F.col("event_id") % 97).cast("int").alias("line"),
        F.concat(F.lit("v"), F.floor(F.col("value") / 10).cast("bigint").cast("string")).alias("evidence"),
        F.col("ts").cast("date").alias("night"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return found.withColumn("finding_id", finding_id())


def findings_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_id"),
        F.concat("l_returnflag", "l_linestatus").alias("rule_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("evidence"),
        F.col("l_shipdate").cast("date").alias("night"),
        F.col("l_orderkey").alias("event_id"),
    )
    return found.withColumn("finding_id", finding_id())


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of all nights before the 25th: the last row of each id, seen from its first to its last night."""
    rows = findings(spark, sf_dir).where("night < '2024-01-25'")
    fields = [c for c in history.FIELDS if c != "finding_id"]
    out = rows.groupBy("finding_id").agg(F.max_by(F.struct(*fields), "event_id").alias("r"), F.min("night").cast("timestamp").alias("first_seen"), F.max("night").cast("timestamp").alias("last_seen"))
    return out.select("finding_id", "r.*", "first_seen", "last_seen", F.array().cast("array<string>").alias("previous_ids"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nights 25 to 30 found, the last row of each id."""
    rows = findings(spark, sf_dir).where("night >= '2024-01-25'")
    return history.last_of_each(rows.select(*history.FIELDS, "event_id"), ["finding_id"], "event_id").drop("event_id")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``previous`` with ``current`` folded in, and moves carried, in one pass over the events."""
    return history.carry_moved(history.merge_nights(findings(spark, sf_dir), F.col("night") >= "2024-01-25", now()), now())


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices, withdrawals, extensions and opt-outs drawn from events by their ids; a notice's reference is its event."""
    e, ts = F.col("event_id"), F.col("ts")
    none_ts, none, day = F.lit(None).cast("timestamp"), F.lit(None).cast("string"), F.expr("interval 1 day")
    channel = F.when(e % 3 == 0, "advisory").when(e % 3 == 1, "email").otherwise("contact_request")

    def entry(kind: str, keep, **values):
        fields = {"server_id": F.col("server_id"), "finding_ids": F.lit(None).cast("array<string>"), "finding_id": F.col("finding_id"), "channel": none, "reference": none, "notified_at": none_ts, "until": none_ts, "acknowledged_at": none_ts, "fixed_at": none_ts}
        return F.when(keep, F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for n, c in (fields | values).items()]))

    drawn = F.array(
        entry("notice", e % 5 == 0, finding_ids=F.array("finding_id"), finding_id=none, channel=channel, reference=e.cast("string"), notified_at=ts, acknowledged_at=F.when(e % 10 == 0, ts + day), fixed_at=F.when(e % 25 == 0, ts + day)),
        entry("withdrawal", e % 50 == 0),
        entry("extension", e % 35 == 0, until=ts + F.expr("interval 120 days")),
        entry("opt_out", e % 100 == 7, server_id=F.lit("s9"), finding_id=none),
    )
    return findings(spark, sf_dir).select(F.explode(F.array_compact(drawn)).alias("x")).select("x.*")


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded history with the state of each finding at the gate's clock."""
    facts, opted = disclosure.disclosure_records(ledger(spark, sf_dir))
    return disclosure.state_by_ledger(folded(spark, sf_dir), facts, opted, gate_clock())


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.publish_findings(stated(spark, sf_dir), now())


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("server_id").distinct().withColumn("repo_url", F.concat(F.lit("https://example.org/"), "server_id"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files, with hidden characters, phrases, imports and odd paths put in by id."""
    d = F.col("doc_id")
    text = F.col("text")
    text = F.when(d % 7 == 0, F.concat(F.lit("x​y "), text)).when(d % 11 == 0, F.concat(text, F.lit("\nend‮of"))).when(d % 13 == 0, F.concat(F.lit("﻿"), text)).otherwise(text)
    text = F.when(d % 5 == 0, F.concat(text, F.lit("\nPlease ignore previous notes"))).otherwise(text)
    text = F.when(d % 9 == 0, F.concat(F.lit("from mcp.server import x\n"), text)).otherwise(text)
    text = F.when(d % 17 == 0, F.concat(text, F.lit('\nconst cp = require("child_process")\ncp.exec(cmd)\napp.listen("0.0.0.0")\ncors({origin: "*"})' + QUIET))).otherwise(text)
    text = F.when(d % 19 == 0, F.concat(text, F.lit('\nimport fs from "fs"\nfs.readFileSync(p)\ndescription: "You \\u0041dd it"' + SAID))).otherwise(text)
    folder = F.when(d % 23 == 0, "tests/").when(d % 29 == 0, "node_modules/").when(d % 31 == 0, "Scripts/").otherwise("src/")
    name = F.when(d % 37 == 0, ".test.ts").when(d % 3 == 0, ".py").when(d % 3 == 1, ".ts").when(d % 41 == 0, ".txt").otherwise(".md")
    size = F.octet_length(F.encode(text, "UTF-8")).cast("long")
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("server_id"), F.concat(folder, "lang", F.lit("/"), d.cast("string"), name).alias("path"), text.alias("source"),
        (size * F.when(d % 43 == 0, 1000).otherwise(1)).alias("size"), (d % 47 == 0).alias("is_symlink"), (d % 53 != 0).alias("is_text"), "doc_id",
    )
    return rows


def entries_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as golden entries with two probabilities in thousandths from fixed hashes of the id."""
    d = F.col("doc_id")
    label = F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "true_positive").otherwise("false_positive")
    # The flagged line of the whole text with the ones before and after it, cut before the join, which then moves no whole texts that nobody reads.
    lines = F.split("text", "\n", -1)
    at = d % F.size(lines)
    first = F.greatest(at, F.lit(1))
    around = F.array_join(F.slice(lines, first.cast("int"), (at + 3 - first).cast("int")), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", around.alias("around")).join(table(spark, sf_dir, "labels"), "doc_id")
    window, function = (d * 7919 % 1001) / 1000.0, (d * 104729 % 1001) / 1000.0
    return rows.select(
        d.alias("entry_id"), F.col("source").alias("server_id"), F.col("lang").alias("rule_id"), label.alias("label"), F.when(d % 4 == 0, "model").otherwise("human").alias("labelled_by"),
        F.when(d % 10 != 3, window).alias("p_window"), F.when(d % 10 != 7, function).alias("p_function"), F.col("text").alias("context"), F.col("around").alias("context_function"), (d % 30).cast("int").alias("line"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators: a says the quality label, b the opposite where a text is toxic; every third row is said again."""
    rows = table(spark, sf_dir, "labels")
    word = lambda c: F.when(c == 1, "true_positive").otherwise("false_positive")
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    a = rows.select(d.alias("entry_id"), word(q).alias("label"), F.lit("r").alias("reason"), F.lit("a").alias("annotator"), (d * 2).alias("seq"))
    b = rows.select(d.alias("entry_id"), word(q.bitwiseXOR(t)).alias("label"), F.lit("r").alias("reason"), F.lit("b").alias("annotator"), (d * 2 + 1).alias("seq"))
    again = rows.where(d % 3 == 0).select(d.alias("entry_id"), F.lit("unsure").alias("label"), F.lit(" ").alias("reason"), F.lit("a").alias("annotator"), (d * 2 + 1_000_000_000).alias("seq"))
    return a.unionByName(b).unionByName(again)


