"""Queries over files and rules, the golden set, triage and evaluation, each with the SQL it is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cache_key
from ..operators import evaluate as ev
from ..operators import files as fi
from ..operators import golden as go
from ..operators import rules as ru
from ..operators import sampling
from ..operators import triage as tr
from ..sources import io
from ..sources.io import settled
from . import sql_views as sv
from . import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# Files and rules


@query(f"WITH {sv.FILES} SELECT server_id, path FROM fs WHERE scannable")
def scannable_files(spark, d):
    return fi.scannable_files(v.files(spark, d)).select("server_id", "path")


@query(f"WITH {sv.FILES} SELECT server_id, path, CASE WHEN is_symlink THEN 'symlink' WHEN size > 1048576 THEN 'too-large' ELSE 'undecodable' END AS reason FROM fs WHERE scannable AND (is_symlink OR size > 1048576 OR NOT is_text)")
def skip_report(spark, d):
    return fi.skipped_files(v.files(spark, d))


@query("SELECT doc_id, 'src/' || substr(text, 1, 1) || CASE WHEN doc_id % 2 = 0 THEN chr(65533) ELSE '' END || '/' || doc_id AS path FROM documents")
def safe_paths(spark, d):
    """Paths as bytes, every second one with a byte that is no UTF-8."""
    whole = lambda c: F.encode(c, "UTF-8")
    bad = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(whole(F.lit("src/")), whole(F.substring("text", 1, 1)), bad, whole(F.concat(F.lit("/"), F.col("doc_id").cast("string"))))
    return v.table(spark, d, "documents").select("doc_id", fi.safe_path(raw).alias("path"))


@query(f"WITH {sv.FILES} SELECT CASE regexp_extract(path, '(\\.[a-z]+)$', 1) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' ELSE 'other' END AS language, count(*) AS files, CAST(sum(length(CASE WHEN starts_with(source, chr(65279)) THEN substr(source, 2) ELSE source END)) AS BIGINT) AS characters FROM ok GROUP BY 1")
def language_mix(spark, d):
    rows = fi.decoded(v.files(spark, d))
    return rows.groupBy(fi.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.length("source")).alias("characters"))


EVIDENCE = "evd AS (SELECT server_id, 'from mcp.server' AS marker, arg_min(path, string_split(path, '/')) AS path FROM fs WHERE source LIKE '%from mcp.server%' AND regexp_extract(path, '(\\.[a-z]+)$', 1) IN ('.py', '.ts') AND NOT path LIKE 'node_modules/%' AND NOT is_symlink AND size <= 1048576 GROUP BY 1)"


@query(f"WITH {sv.FILES}, {EVIDENCE} SELECT * FROM evd")
def server_evidence(spark, d):
    return fi.server_evidence(v.files(spark, d))


OUTCOMES = "oc AS (SELECT DISTINCT server_id, CASE WHEN CAST(substr(server_id, 4) AS INTEGER) % 2 = 0 THEN 'registry' ELSE 'code-search' END AS discovered_via, CASE CAST(substr(server_id, 4) AS INTEGER) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'unreachable' ELSE 'scanned' END AS status FROM fl)"


def _outcomes(spark, d):
    n = F.substring("server_id", 4, 9).cast("int")
    return v.files(spark, d).select("server_id").distinct().select("server_id", F.when(n % 2 == 0, "registry").otherwise("code-search").alias("discovered_via"), F.when(n % 5 == 0, "failed").when(n % 5 == 1, "unreachable").otherwise("scanned").alias("status"))


@query(f"WITH {sv.FILES}, {EVIDENCE}, {OUTCOMES} SELECT server_id, status <> 'failed' AND (discovered_via = 'registry' OR marker IS NOT NULL) AS admitted, CASE WHEN status = 'failed' OR discovered_via = 'registry' THEN NULL WHEN marker IS NOT NULL THEN marker || ' in ' || path ELSE 'no server SDK import found' END AS note FROM oc LEFT JOIN evd USING (server_id)")
def admission(spark, d):
    return fi.admit(_outcomes(spark, d), fi.server_evidence(v.files(spark, d)))


@query(f"WITH {sv.FILES}, {OUTCOMES} SELECT count(*) FILTER (WHERE status = 'scanned') AS scanned, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('scanned', 'failed')) AS skipped FROM oc")
def scan_status(spark, d):
    return fi.scan_status_counts(_outcomes(spark, d))


HID = "[\\x{E0000}-\\x{E007F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200B}\\x{FEFF}]"


@query(
    f"WITH {sv.FILES}, s AS (SELECT server_id, path, string_split(CASE WHEN starts_with(source, chr(65279)) THEN substr(source, 2) ELSE source END, chr(10)) AS ls FROM ok WHERE regexp_matches(source, '{HID}')), u AS (SELECT server_id, path, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM s), x AS (SELECT server_id, path, CAST(line AS INTEGER) AS line, unicode(regexp_extract(t, '{HID}')) AS cp FROM u WHERE regexp_matches(t, '{HID}')), y AS (SELECT *, CASE WHEN cp BETWEEN 917504 AND 917631 THEN 'unicode-tag-block' WHEN cp BETWEEN 8234 AND 8238 THEN 'bidi-override' WHEN cp BETWEEN 8294 AND 8297 THEN 'bidi-isolate' WHEN cp = 8203 THEN 'zero-width-space' ELSE 'zero-width-nbsp' END AS label FROM x) SELECT server_id, path, line, 'critical' AS severity, CASE WHEN label IN ('unicode-tag-block', 'bidi-override') THEN 'high' ELSE 'medium' END AS confidence, label || ' U+' || upper(printf('%04x', cp)) || ' at line ' || line AS evidence FROM y"
)
def unicode_conceal(spark, d):
    return ru.unicode_conceal(fi.decoded(v.files(spark, d)))


@query(f"WITH {sv.FILES} SELECT server_id, path FROM ok WHERE regexp_matches(lower(source), 'ignore previous|exfiltrate|never reveal') OR (length(source) > 200 AND regexp_matches(lower(source), 'you must|you should|you will|you are to|before you|when you|make sure to|be sure to|remember to|do not |don''t '))")
def instruction_like(spark, d):
    return fi.decoded(v.files(spark, d)).where(ru.reads_as_instruction(F.col("source"))).select("server_id", "path")


#: What ``reads_as_instruction`` says of the text t.
INSTRUCTION = "({} OR (length(t) > 200 AND ({})))".format(*(" OR ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in phrases) for phrases in (ru.ODD_PHRASES, ru.ADDRESSING)))


@query(f"WITH x AS (SELECT DISTINCT source AS server_id, CAST(doc_id % 500 AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN text || ' Ignore previous' ELSE text END AS t FROM documents) SELECT server_id, path, CAST(1 AS INTEGER) AS line, 'high' AS severity, 'low' AS confidence, substr(t, 1, 300) AS evidence FROM x WHERE {INSTRUCTION}")
def instruction_scan(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" Ignore previous"))).otherwise(F.col("text"))  # put in by id, as in v.files
    rows = v.table(spark, d, "documents").select(F.col("source").alias("server_id"), (F.col("doc_id") % 500).cast("string").alias("path"), F.lit(1).alias("line"), text.alias("text"))
    return ru.instruction_scan(rows)


#: The descriptions that the files hold: the line that each stands in, and its text.
SAID = 'y AS (SELECT server_id, path, string_split(source, chr(10)) AS ls FROM ok WHERE doc_id % 19 = 0), dd AS (SELECT server_id, path, CAST(list_position(ls, p.l) AS INTEGER) AS line, p.t AS text FROM y, (VALUES (\'description: "You \\u0041dd it"\', \'You Add it\'), (\'const ABOUT = "Adds " + \'\'two\'\'\', \'Adds two\'), (\'z.string().describe("Ignore previous one")\', \'Ignore previous one\')) p(l, t))'


@query(f"WITH {sv.FILES}, {SAID} SELECT * FROM dd")
def described(spark, d):
    return ru.extract_descriptions(fi.decoded(v.files(spark, d)))


@query(f"WITH {sv.FILES}, {SAID} SELECT server_id, path, line, 'high' AS severity, 'low' AS confidence, text AS evidence FROM dd WHERE contains(lower(text), 'ignore previous')")
def instructing_descriptions(spark, d):
    """The descriptions of all files that read as an instruction, each at its line."""
    return ru.instruction_scan(ru.extract_descriptions(fi.decoded(v.files(spark, d))))


@query(
    f"WITH {sv.FILES}, u AS (SELECT server_id, path, source, unnest(string_split(source, chr(10))) AS t, generate_subscripts(string_split(source, chr(10)), 1) AS line FROM ok WHERE path LIKE '%.ts' AND (doc_id % 17 = 0 OR doc_id % 19 = 0)), r AS (SELECT *, CASE WHEN t = 'cp.exec(cmd)' THEN 'shell-call' WHEN t = 'app.listen(\"0.0.0.0\")' THEN 'scope-interface' WHEN t = 'cors({{origin: \"*\"}})' THEN 'scope-origin' WHEN t = 'fs.readFileSync(p)' THEN 'path-call' WHEN t = 'const run = `${{cp.exec(again)}}`' THEN 'shell-call' END AS rule_id FROM u) SELECT server_id, path, CAST(line AS INTEGER) AS line, rule_id, CASE rule_id WHEN 'shell-call' THEN 'critical' WHEN 'path-call' THEN 'high' ELSE 'medium' END AS severity, 'low' AS confidence, t AS evidence FROM r WHERE rule_id IS NOT NULL"
)
def pattern_scan(spark, d):
    return ru.pattern_scan(fi.decoded(v.files(spark, d)), ru.line_rules(spark))


class _Shouting(ru.FileRule):
    """Lines without a lower-case letter but with '!!'; fails on files that hold '%%%' (to show isolation)."""

    rule_id = "shouting"
    suffixes = (".ts", ".py")

    def analyze(self, path, source):
        if "%%%" in source:
            raise ValueError("odd marks")
        for n, line in enumerate(source.split("\n"), 1):
            if "!!" in line:
                yield n, "info", "low", line[:20]


HOOK = "hk AS (SELECT server_id, path, CASE WHEN starts_with(source, chr(65279)) THEN substr(source, 2) ELSE source END AS source, contains(source, '%%%') AS bad FROM ok WHERE path LIKE '%.ts' OR path LIKE '%.py'), hu AS (SELECT server_id, path, unnest(string_split(source, chr(10))) AS t, generate_subscripts(string_split(source, chr(10)), 1) AS line FROM hk WHERE NOT bad)"


@query(f"WITH {sv.FILES}, {HOOK} SELECT server_id, path, CAST(line AS INTEGER) AS line, 'shouting' AS rule_id, substr(t, 1, 20) AS evidence, NULL::VARCHAR AS error FROM hu WHERE contains(t, '!!') UNION ALL SELECT server_id, path, NULL, 'shouting', NULL, 'ValueError: odd marks' FROM hk WHERE bad")
def rule_hook(spark, d):
    return ru.apply_rules(fi.decoded(v.files(spark, d)), [_Shouting()]).select("server_id", "path", "line", "rule_id", "evidence", "error")


@query(f"WITH {sv.FILES}, {HOOK}, x AS (SELECT server_id, 'ValueError: odd marks' AS message FROM hk WHERE bad UNION SELECT server_id, NULL FROM ok) SELECT server_id, CASE WHEN min(message) IS NULL THEN 'scanned' ELSE 'failed' END AS status, min(message) AS message FROM x GROUP BY 1")
def isolated_failures(spark, d):
    files = fi.decoded(v.files(spark, d))
    return ru.isolate_failures(ru.apply_rules(files, [_Shouting()]), files)


# Golden set


@query(f"WITH {sv.FINDINGS}, k AS (SELECT DISTINCT finding_id FROM f WHERE event_id % 200 = 0), u AS (SELECT DISTINCT finding_id, rule_id FROM f), m AS (SELECT u.*, k.finding_id IS NOT NULL AS held FROM u LEFT JOIN k USING (finding_id)), c AS (SELECT *, count(*) FILTER (WHERE held) OVER (PARTITION BY rule_id) AS nh, row_number() OVER (PARTITION BY rule_id, held ORDER BY sha256('11:' || finding_id), finding_id) AS rn FROM m) SELECT finding_id, rule_id, held FROM c WHERE held OR rn <= greatest(25 - nh, 0)")
def stratified_topup(spark, d):
    rows = v.findings(spark, d)
    return sampling.stratified_sample(rows.select("finding_id", "rule_id").distinct(), rows.where("event_id % 200 = 0").select("finding_id").distinct(), 25, 11)


@query(f"WITH {sv.GOLDEN} SELECT server_id, entry_id FROM g QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY sha256('5:' || entry_id), entry_id) = 1")
def one_per_group(spark, d):
    return sampling.one_per_group(v.entries_golden(spark, d).select("server_id", "entry_id"), "server_id", "entry_id", 5)


@query(
    f"WITH {sv.GOLDEN}, s AS (SELECT entry_id, line, context, string_split_regex(context, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM g), t AS (SELECT *, CASE WHEN context = '' THEN [] WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS l2 FROM s) SELECT entry_id, least(line - 1, 12) AS flagged_offset, CASE WHEN line >= 1 AND line <= len(l2) THEN array_to_string(l2[greatest(line - 12, 1):least(line + 12, len(l2))], chr(10)) END AS context FROM t"
)
def context_window(spark, d):
    rows = v.entries_golden(spark, d).select("entry_id", "line", F.col("context").alias("source"))
    return go.capture_context(rows).select("entry_id", go.flagged_offset(F.col("line")).alias("flagged_offset"), "context")


@query(f"WITH {sv.FINDINGS}, a AS (SELECT DISTINCT finding_id FROM f WHERE night = DATE '2024-01-24'), b AS (SELECT DISTINCT finding_id FROM f WHERE night >= DATE '2024-01-25') SELECT finding_id, finding_id IN (SELECT finding_id FROM b) AS kept FROM a")
def captured(spark, d):
    rows = v.findings(spark, d)
    kept, dropped = go.capture_for_findings(rows.where("night = '2024-01-24'").select("finding_id").distinct(), rows.where("night >= '2024-01-25'"))
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.select("finding_id", F.lit(False).alias("kept")))


@query(
    f"WITH {sv.FINDINGS}, dr AS (SELECT finding_id, min(event_id) AS position, CASE WHEN min(event_id) % 6 <> 0 THEN 'c' END AS context FROM f GROUP BY 1), ex AS (SELECT finding_id, 'g-' || printf('%04d', min(event_id) + 1) AS entry_id, 'true_positive' AS label FROM f WHERE event_id % 3 = 0 GROUP BY 1), j AS (SELECT dr.finding_id, position, ex.entry_id, ex.label FROM dr LEFT JOIN ex USING (finding_id) WHERE context IS NOT NULL) SELECT finding_id, entry_id, label FROM j WHERE entry_id IS NOT NULL UNION ALL SELECT finding_id, 'g-' || printf('%04d', row_number() OVER (ORDER BY position, finding_id) + (SELECT max(CAST(substr(entry_id, 3) AS INTEGER)) FROM ex)), NULL FROM j WHERE entry_id IS NULL"
)
def golden_entries(spark, d):
    rows = v.findings(spark, d)
    drawn = rows.groupBy("finding_id").agg(F.min("event_id").alias("position")).withColumn("context", F.when(F.col("position") % 6 != 0, "c"))
    old = rows.where("event_id % 3 = 0").groupBy("finding_id").agg(F.min("event_id").alias("e"))
    return go.build_entries(drawn, old.select("finding_id", F.format_string("g-%04d", F.col("e") + 1).alias("entry_id"), F.lit("true_positive").alias("label"))).select("finding_id", "entry_id", "label")


@query(f"WITH {sv.GOLDEN} SELECT entry_id, round(length(context_function) / length(context), 6) AS share FROM g WHERE length(context) > 0 AND length(context_function) / length(context) < 0.05")
def suspect_functions(spark, d):
    return rounded(go.suspect_functions(v.entries_golden(spark, d)).select("entry_id", "share"), "share")


PRESENTED = """pl AS (SELECT entry_id, least(greatest(line, 1) - 1, 12) AS o, CASE WHEN context = '' THEN [] WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS l FROM (SELECT *, string_split_regex(context, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM g)),
pm AS (SELECT entry_id, least(o, len(l) - 1) AS m, list_transform(l, lambda x, i: (CASE WHEN i = o + 1 THEN '> ' ELSE '  ' END) || (CASE WHEN length(x) <= 200 THEN x ELSE substr(x, 1, 200) || ' [truncated]' END)) AS s FROM pl),
pg AS (SELECT entry_id, 0 AS d, length(s[m + 1]) AS size, '' AS above, '' AS below, true AS open FROM pm WHERE len(s) > 0
  UNION ALL SELECT entry_id, d, CASE WHEN df THEN size2 + length(dn) + 1 ELSE size2 END, CASE WHEN uf THEN up || chr(10) || above ELSE above END, CASE WHEN df THEN below || chr(10) || dn ELSE below END, uf OR df
  FROM (SELECT *, coalesce(size2 + length(dn) + 1 <= 8000, false) AS df FROM (SELECT *, CASE WHEN uf THEN size + length(up) + 1 ELSE size END AS size2 FROM (SELECT *, coalesce(size + length(up) + 1 <= 8000, false) AS uf FROM (
    SELECT pg.entry_id, pg.d + 1 AS d, size, above, below, CASE WHEN m - pg.d - 1 >= 0 THEN s[m - pg.d] END AS up, CASE WHEN m + pg.d + 1 < len(s) THEN s[m + pg.d + 2] END AS dn FROM pg JOIN pm USING (entry_id) WHERE open)))))"""


@query(f"WITH RECURSIVE {sv.GOLDEN}, {PRESENTED} SELECT pm.entry_id, sha256(coalesce(above || s[m + 1] || below, '')) AS shown FROM pm LEFT JOIN (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY d DESC) = 1) USING (entry_id)")
def presented(spark, d):
    rows = v.entries_golden(spark, d).withColumn("flagged_offset", go.flagged_offset(F.greatest("line", F.lit(1))))
    return go.present(rows.select("entry_id", "context", "flagged_offset")).select("entry_id", F.sha2(F.encode("presented", "UTF-8"), 256).alias("shown"))


@query(f"WITH {sv.GOLDEN} SELECT entry_id, context_function AS shown FROM g")
def conditions(spark, d):
    return go.as_condition(go.eligible(v.entries_golden(spark, d)), "function").select("entry_id", "shown")


@query(f"WITH {sv.GOLDEN} SELECT annotator, entry_id, label, seq FROM la")
def latest_annotations(spark, d):
    return go.latest_annotations(v.annotations(spark, d)).select("annotator", "entry_id", "label", "seq")


MERGED = "ml AS (SELECT la.entry_id, CASE WHEN la.entry_id % 6 = 0 THEN 'false_positive' WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, la.entry_id % 6 <> 0 AND count(DISTINCT label) > 1 AS conflict, string_agg(DISTINCT annotator, ',' ORDER BY annotator) AS annotators FROM la GROUP BY la.entry_id)"


@query(f"WITH {sv.GOLDEN}, {MERGED} SELECT * FROM ml")
def label_merge(spark, d):
    settled = v.table(spark, d, "labels").where("doc_id % 6 = 0").select(F.col("doc_id").alias("entry_id"), F.lit("false_positive").alias("label"))
    return go.merge_human_labels(go.latest_annotations(v.annotations(spark, d)), settled).withColumn("annotators", F.array_join("annotators", ","))


@query(f"WITH {sv.GOLDEN} SELECT entry_id, label FROM an WHERE trim(reason) <> '' QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) = 1")
def valid_adjudications(spark, d):
    return go.valid_adjudications(v.annotations(spark, d)).select("entry_id", "label")


def _observed(spark, d):
    e = F.col("entry_id")
    obs = lambda label: F.struct(label.alias("label"), F.lit("model").alias("labelled_by"), F.lit("seen").alias("reason"))
    w = F.when(F.col("p_window") >= 0.5, "true_positive").otherwise("false_positive")
    f = F.when(F.col("p_function") >= 0.5, "true_positive").otherwise("false_positive")
    rows = v.entries_golden(spark, d).where("p_window is not null and p_function is not null")
    return rows.withColumn("label", F.when(e % 3 == 0, F.col("label"))).withColumn("observations", F.create_map(F.lit("window"), obs(w), F.lit("function"), obs(f)))


OBS = "ob AS (SELECT entry_id, labelled_by, CASE WHEN entry_id % 3 = 0 THEN label END AS label, CASE WHEN p_window >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS w, CASE WHEN p_function >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS f FROM gp)"


@query(f"WITH {sv.GOLDEN}, {OBS} SELECT entry_id, CASE WHEN labelled_by = 'human' AND label IS NOT NULL THEN label WHEN w = f THEN w END AS published, NOT (labelled_by = 'human' AND label IS NOT NULL) AND w <> f AS contested FROM ob")
def published_labels(spark, d):
    return _observed(spark, d).select("entry_id", go.published_label().alias("published"), go.is_contested().alias("contested"))


@query(f"WITH {sv.GOLDEN}, {OBS} SELECT count(*) FILTER (WHERE NOT (labelled_by = 'human' AND label IS NOT NULL) AND w <> f) AS contested, count(*) FILTER (WHERE (labelled_by = 'human' AND label IS NOT NULL) OR w = f) AS publishable FROM ob")
def benchmark_consequence(spark, d):
    return _observed(spark, d).agg(F.count_if(go.is_contested()).alias("contested"), F.count_if(go.published_label().isNotNull()).alias("publishable"))


@query(f"WITH {sv.GOLDEN}, {OBS} SELECT entry_id, CASE WHEN entry_id % 5 = 0 THEN 'unsure' ELSE w END AS window_label, CASE WHEN entry_id % 5 = 0 THEN w END AS superseded FROM ob")
def observations(spark, d):
    rows = _observed(spark, d)
    rows = rows.withColumn("observations", F.transform_values("observations", lambda _, o: F.struct(o["label"].alias("label"), o["labelled_by"].alias("labelled_by"), F.lit(None).cast("string").alias("superseded"))))
    news = rows.where("entry_id % 5 = 0").select("entry_id", F.lit("window").alias("condition"), F.lit("unsure").alias("label"), F.lit("human").alias("labelled_by"), F.lit("").alias("reason"))
    out = go.apply_observation(rows, news)
    return out.select("entry_id", F.col("observations")["window"]["label"].alias("window_label"), F.col("observations")["window"]["superseded"].alias("superseded"))


@query(f"WITH {sv.GOLDEN}, {OBS} SELECT count(label) AS judged, count(*) AS total, min(entry_id) FILTER (WHERE label IS NULL) AS next_entry FROM ob")
def progress(spark, d):
    return go.progress(_observed(spark, d))


@query(f"WITH {sv.GOLDEN} SELECT entry_id, CASE WHEN p_function IS NULL THEN 0.25 ELSE p_function END AS function_p FROM g")
def recorded_probabilities(spark, d):
    rows = v.entries_golden(spark, d).withColumn("probabilities", F.create_map(F.lit("function"), F.lit(0.25).cast("double")))
    return go.record_probabilities(rows, rows.select("entry_id", F.col("p_function").alias("probability")), "function").select("entry_id", F.col("probabilities")["function"].alias("function_p"))


@query(f"WITH {sv.GOLDEN} SELECT entry_id, CASE WHEN labelled_by = 'human' THEN label WHEN p_window >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS window_label FROM g WHERE p_window IS NOT NULL")
def recorded_verdicts(spark, d):
    rows = v.entries_golden(spark, d).where("p_window is not null").withColumn("probabilities", F.create_map(F.lit("window"), F.col("p_window")))
    rows = rows.withColumn("observations", F.create_map(F.lit("window"), F.struct("label", "labelled_by", F.lit("").alias("reason"))))
    return rows.select("entry_id", go.record_verdicts()["window"]["label"].alias("window_label"))


QUEUE = "qq AS (SELECT entry_id FROM gp WHERE (p_window >= 0.5) <> (p_function >= 0.5) UNION SELECT entry_id FROM (SELECT entry_id FROM gp ORDER BY sha256('3:' || entry_id), entry_id LIMIT 60)), qp AS (SELECT entry_id, CAST(row_number() OVER (ORDER BY sha256('4:' || entry_id), entry_id) AS INTEGER) AS position FROM qq)"


def _queue(spark, d):
    return go.annotation_sample(ev.paired(v.entries_golden(spark, d)), 60, 3)


@query(f"WITH {sv.GOLDEN}, {QUEUE} SELECT entry_id, position FROM qp")
def annotation_queue(spark, d):
    return _queue(spark, d)


@query(f"WITH {sv.GOLDEN}, {QUEUE} SELECT position, entry_id, rule_id, context_function FROM qp JOIN g USING (entry_id)")
def blind_queue(spark, d):
    return go.blind_queue(_queue(spark, d), v.entries_golden(spark, d), ["entry_id", "rule_id", "context_function"])


TREE = (
    "lf AS (SELECT study, entry_id, sha256(entry_id || ':' || d || ':' || count(*)) AS place, count(*) AS n FROM (SELECT study, entry_id, sha256('{\"entry_id\":' || entry_id || ',\"rule_id\":\"' || rule_id || '\",\"label\":\"' || label || '\"}') AS d FROM r) GROUP BY study, entry_id, d),"
    " dp AS (SELECT count(*) AS depth FROM range(12) t(i), (SELECT count(*) AS c FROM g) WHERE 64 * pow(16, i) < c),"
    " tr(study, lvl, node, h, n) AS (SELECT study, depth, substr(place, 1, depth), sha256(string_agg(place, '' ORDER BY place)), sum(n) FROM lf, dp GROUP BY 1, 2, 3"
    " UNION ALL SELECT study, lvl - 1, substr(node, 1, lvl - 1), sha256(string_agg(h, '' ORDER BY node)), sum(n) FROM tr WHERE lvl > 0 GROUP BY 1, 2, 3)"
)
REGISTERED = "SELECT 'as registered' AS study, entry_id, rule_id, label FROM g"


@query(f"WITH RECURSIVE {sv.GOLDEN}, r AS ({REGISTERED}), {TREE} SELECT h AS digest, CAST(n AS BIGINT) AS entries FROM tr WHERE lvl = 0")
def snapshot_digest(spark, d):
    return go.snapshot_digest(v.entries_golden(spark, d), ["entry_id", "rule_id", "label"])


@query(
    f"WITH RECURSIVE {sv.GOLDEN}, r AS ({REGISTERED} UNION ALL SELECT 'one entry changed', entry_id, rule_id, CASE WHEN entry_id = (SELECT min(entry_id) FROM g) THEN 'changed' ELSE label END FROM g UNION ALL SELECT 'gone and doubled', entry_id, rule_id, label FROM g WHERE entry_id % 64 <> 5 UNION ALL SELECT 'gone and doubled', entry_id, rule_id, label FROM g WHERE entry_id % 64 = 7), {TREE},"
    " df AS (SELECT s.study, l.entry_id, 1 AS was, 0 AS now FROM (SELECT DISTINCT study FROM r) s, lf l WHERE l.study = 'as registered' AND (s.study, l.place) NOT IN (SELECT study, place FROM lf) UNION ALL SELECT study, entry_id, 0, 1 FROM lf WHERE place NOT IN (SELECT place FROM lf WHERE study = 'as registered')),"
    " ch AS (SELECT study, entry_id, CASE WHEN max(was) = 1 AND max(now) = 1 THEN 'changed' WHEN max(was) = 1 THEN 'gone' ELSE 'added' END AS change FROM df GROUP BY 1, 2)"
    " SELECT study, h AS digest, h = (SELECT h FROM tr WHERE lvl = 0 AND study = 'as registered') AS frozen, entry_id, change FROM tr LEFT JOIN ch USING (study) WHERE lvl = 0"
)
def frozen_study(spark, d):
    """The entries as they were registered, with one label changed, and with some entries gone and others there twice: the root of each and what changed."""
    rows, fields = settled(v.entries_golden(spark, d).select("entry_id", "rule_id", "label")), ["entry_id", "rule_id", "label"]
    before = go.snapshot_tree(rows, fields)
    depth = before.agg(F.max("level")).first()[0] - 1
    least = rows.agg(F.min("entry_id").alias("least"))
    relabelled = rows.crossJoin(F.broadcast(least)).withColumn("label", F.when(F.col("entry_id") == F.col("least"), "changed").otherwise(F.col("label"))).drop("least")  # one row
    thinned = rows.where("entry_id % 64 <> 5").union(rows.where("entry_id % 64 = 7"))
    root, out = before.where("level = 0").select(F.col("digest").alias("expected")), []
    for study, now in (("as registered", rows), ("one entry changed", relabelled), ("gone and doubled", thinned)):
        after = go.snapshot_tree(now, fields, depth)
        roots = after.where("level = 0").crossJoin(root).select(F.lit(study).alias("study"), "digest", (F.col("digest") == F.col("expected")).alias("frozen"))
        out.append(roots.join(go.changed_entries(before, after).withColumn("study", F.lit(study)), "study", "left"))
    return reduce(DataFrame.union, out)


@query(
    f"WITH {sv.GOLDEN}, {QUEUE}, lb AS (SELECT DISTINCT entry_id FROM g WHERE labelled_by = 'human'), dp AS (SELECT entry_id FROM la GROUP BY 1 HAVING count(DISTINCT label) > 1), ad AS (SELECT DISTINCT entry_id FROM g WHERE entry_id % 2 = 0) SELECT 'labelled outside the queue' AS \"check\", count(*) AS broken FROM lb WHERE entry_id NOT IN (SELECT entry_id FROM qq) UNION ALL SELECT 'queued without a label', count(*) FROM qq WHERE entry_id NOT IN (SELECT entry_id FROM lb) UNION ALL SELECT 'settled without a dispute', count(*) FROM ad WHERE entry_id NOT IN (SELECT entry_id FROM dp) UNION ALL SELECT 'open conflict', count(*) FROM dp WHERE entry_id NOT IN (SELECT entry_id FROM ad)"
)
def study_checks(spark, d):
    rows = v.entries_golden(spark, d)
    disputed = go.latest_annotations(v.annotations(spark, d)).groupBy("entry_id").agg(F.count_distinct("label").alias("k")).where("k > 1")
    return go.study_checks(_queue(spark, d), rows.where("labelled_by = 'human'"), rows.where("entry_id % 2 = 0"), disputed)


@query(f"WITH {sv.GOLDEN}, tp AS (SELECT entry_id FROM gp ORDER BY round(abs(p_function - 0.5) - abs(p_window - 0.5), 9) DESC, entry_id LIMIT 40) SELECT entry_id, 'gain' AS chosen_by FROM tp UNION ALL SELECT * FROM (SELECT entry_id, 'control' FROM gp WHERE entry_id NOT IN (SELECT entry_id FROM tp) ORDER BY sha256('9:' || entry_id), entry_id LIMIT 40)")
def label_priority(spark, d):
    return go.label_priority(ev.paired(v.entries_golden(spark, d)), 40, 9)


@query(f"WITH {sv.GOLDEN}, ru AS (SELECT * FROM (VALUES ('en', true), ('fr', false), ('de', true)) t(rule_id, needs)) SELECT entry_id, needs AS needs_enclosing_function, needs IS NOT NULL AS known_rule FROM g LEFT JOIN ru USING (rule_id)")
def split_by_prediction(spark, d):
    rules = spark.createDataFrame([("en", True), ("fr", False), ("de", True)], "rule_id string, needs_enclosing_function boolean")
    return go.split_by_prediction(v.entries_golden(spark, d), rules).select("entry_id", "needs_enclosing_function", "known_rule")


@query(f"WITH {sv.GOLDEN} SELECT entry_id AS finding_id, 'r' AS reason FROM la WHERE label = 'true_positive' GROUP BY 1")
def human_true_positives(spark, d):
    from ..operators.disclosure import human_true_positives as op

    said = v.annotations(spark, d)
    return op(said, said.select("entry_id", F.col("entry_id").alias("finding_id")).distinct())


# Triage


@query(f"WITH {sv.GOLDEN} SELECT entry_id, sha256('window|' || rule_id || '|python|' || sha256(context_function)) AS key FROM g")
def cache_keys(spark, d):
    return v.entries_golden(spark, d).select("entry_id", cache_key(F.lit("window"), F.col("rule_id"), F.lit("python"), F.col("context_function")).alias("key"))


def _judge(text: str) -> tuple[float, float]:
    if len(text) < 12:
        raise ValueError("too little to judge")
    if len(text) % 3 == 0:  # every third question or so
        raise TimeoutError("no answer")
    return (len(text) * 37 % 101) / 100.0, 0.001


@query(
    f"WITH {sv.GOLDEN}, q AS (SELECT entry_id, sha256('window|' || rule_id || '|python|' || sha256(context_function)) AS key, context_function AS shown FROM g), c AS (SELECT key, 0.75 AS p FROM q GROUP BY key HAVING min(entry_id) % 7 = 0), o AS (SELECT key, min(entry_id) AS first, length(min(shown)) >= 12 AND length(min(shown)) % 3 <> 0 AS ok FROM q WHERE key NOT IN (SELECT key FROM c) GROUP BY 1), a AS (SELECT key, ok FROM o QUALIFY coalesce(sum(CAST(ok AS INTEGER)) OVER (ORDER BY first, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 150) SELECT entry_id, CASE WHEN c.key IS NOT NULL THEN c.p WHEN a.ok THEN (length(q.shown) * 37 % 101) / 100.0 END AS probability, CASE WHEN c.key IS NOT NULL THEN 'cache' WHEN a.key IS NULL THEN 'over budget' WHEN NOT a.ok THEN 'failed' ELSE 'judge' END AS source FROM q LEFT JOIN c USING (key) LEFT JOIN a USING (key)"
)
def adjudicate_budget(spark, d):
    rows = v.entries_golden(spark, d).select("entry_id", cache_key(F.lit("window"), F.col("rule_id"), F.lit("python"), F.col("context_function")).alias("key"), F.col("context_function").alias("shown"))
    rows = io.settled(rows)  # read by the cache and by the entries
    cache = rows.groupBy("key").agg(F.min("entry_id").alias("e")).where("e % 7 = 0").select("key", F.lit(0.75).alias("probability"))
    return tr.adjudicate(rows, cache, _judge, 150)[0].select("entry_id", "probability", "source")


CALLS = "ca AS (SELECT event_id, event_type AS arm, value / 1000 AS cost_usd, CASE WHEN event_id % 13 = 0 THEN 'call for g-' || event_id || ' timed out after ' || (event_id % 3) END AS failure, CASE WHEN event_id % 17 = 0 THEN 1.5 WHEN event_id % 19 = 0 THEN 'nan'::DOUBLE ELSE (event_id % 101) / 100.0 END AS probability FROM events)"


def _calls(spark, d):
    e = F.col("event_id")
    failure = F.when(e % 13 == 0, F.concat(F.lit("call for g-"), e.cast("string"), F.lit(" timed out after "), (e % 3).cast("string")))
    p = F.when(e % 17 == 0, 1.5).when(e % 19 == 0, float("nan")).otherwise((e % 101) / 100.0)
    return v.table(spark, d, "events").select("event_id", F.col("event_type").alias("arm"), (F.col("value") / 1000).alias("cost_usd"), failure.alias("failure"), p.alias("probability"))


@query(f"WITH {CALLS}, w AS (SELECT *, coalesce(sum(round(cost_usd * 100000)::BIGINT) OVER (PARTITION BY arm ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ca) SELECT event_id, arm FROM w WHERE before < 1000005")
def spend_cap(spark, d):
    calls = _calls(spark, d).withColumn("cost_usd", F.round(F.col("cost_usd") * 100000).cast("long"))
    return tr.spend_cap(calls, 1000005, "event_id", "arm").select("event_id", "arm")


@query(f"WITH {CALLS} SELECT substr(regexp_replace(failure, 'g-\\d+', 'g-#', 'g'), 1, 160) AS reason, count(*) AS n FROM ca WHERE failure IS NOT NULL GROUP BY 1")
def failure_reasons(spark, d):
    return tr.failure_reasons(_calls(spark, d))


@query(f"WITH {sv.GOLDEN} SELECT entry_id, 1.0 AS probability, 'judge' AS source FROM g")
def rules_only(spark, d):
    rows = v.entries_golden(spark, d).select("entry_id", cache_key(F.lit("window"), F.col("rule_id"), F.lit("python"), F.col("context")).alias("key"), F.col("context").alias("shown"))
    empty = spark.createDataFrame([], "key string, probability double")
    return tr.adjudicate(rows, empty, tr.rules_only, 1 << 30)[0].select("entry_id", "probability", "source")


@query(f"WITH {CALLS} SELECT count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM ca")
def run_totals(spark, d):
    return rounded(tr.run_totals(_calls(spark, d)), "cost_usd", digits=4)


@query(f"WITH {CALLS} SELECT count(*) AS valid FROM ca WHERE NOT isnan(probability) AND probability BETWEEN 0 AND 1 AND cost_usd >= 0")
def valid_decisions(spark, d):
    return _calls(spark, d).where(tr.valid_decision()).agg(F.count("*").alias("valid"))


@query(f"WITH {CALLS}, {sv.GOLDEN} SELECT round(avg(cost_usd), 6) AS per_call, (SELECT count(*) FROM gp) AS pool, round(avg(cost_usd) * 2 * (SELECT count(*) FROM gp), 4) AS projected, avg(cost_usd) * 2 * (SELECT count(*) FROM gp) > 10 AS over_cap FROM (SELECT * FROM ca ORDER BY sha256('2:' || event_id), event_id LIMIT 40)")
def cost_projection(spark, d):
    sampled = sampling.hashed_draw(_calls(spark, d), 40, 2, ["event_id"])
    out = tr.cost_projection(ev.paired(v.entries_golden(spark, d)), sampled, 10.0)
    return out.withColumns({"per_call": F.round("per_call", 6), "projected": F.round("projected", 4)})


@query("SELECT l_orderkey, l_linenumber, round((l_partkey * 2.5 + l_suppkey * 10.0) / 1e6, 9) AS cost FROM lineitem")
def token_cost(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(tr.token_cost(F.col("l_partkey"), F.col("l_suppkey"), 2.5, 10.0), 9).alias("cost"))


# Evaluation


def _labels(spark, d):
    rows = v.entries_golden(spark, d)
    return rows.select("entry_id", "rule_id", "label"), rows.select("entry_id", F.coalesce(F.col("p_window") >= 0.5, F.lit(False)).alias("verdict"))


SCORES = "sc AS (SELECT rule_id, count(*) FILTER (WHERE label = 'true_positive' AND s) AS tp, count(*) FILTER (WHERE label <> 'true_positive' AND s) AS fp, count(*) FILTER (WHERE label = 'true_positive' AND NOT s) AS fn, count(*) AS support FROM (SELECT rule_id, label, coalesce(p_window >= 0.5, false) AS s FROM g WHERE label <> 'unsure') GROUP BY 1), sd AS (SELECT rule_id, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, support FROM sc)"


@query(f"WITH {sv.GOLDEN}, {SCORES} SELECT rule_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, support FROM sd")
def rule_scores(spark, d):
    return rounded(ev.score_rules(*_labels(spark, d)), "precision", "recall", "f1")


@query(f"WITH {sv.GOLDEN} SELECT entry_id, 'label' AS side FROM g WHERE entry_id % 50 = 1 UNION ALL SELECT entry_id, 'prediction' FROM g WHERE entry_id % 50 = 2")
def unmatched_entries(spark, d):
    labels, said = _labels(spark, d)
    return ev.unmatched(labels.where("entry_id % 50 <> 2"), said.where("entry_id % 50 <> 1"))


@query(f"WITH {sv.GOLDEN}, {SCORES}, po AS (SELECT lang AS rule_id, count(*) AS n FROM documents GROUP BY 1) SELECT round(sum(p * n) / sum(n), 6) AS weighted_precision FROM sd JOIN po USING (rule_id)")
def weighted_precision(spark, d):
    population = v.table(spark, d, "documents").groupBy(F.col("lang").alias("rule_id")).agg(F.count("*").alias("population"))
    return rounded(ev.weighted_precision(ev.score_rules(*_labels(spark, d)), population), "weighted_precision")


SWEEP = "sw AS (SELECT k / 100.0 AS threshold, count(*) FILTER (WHERE label = 'true_positive' AND p_window >= k / 100.0) AS tp, count(*) FILTER (WHERE label <> 'true_positive' AND p_window >= k / 100.0) AS fp, count(*) FILTER (WHERE label = 'true_positive' AND p_window < k / 100.0) AS fn FROM g, range(101) t(k) WHERE label <> 'unsure' AND p_window IS NOT NULL GROUP BY 1), sx AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM sw)"


def _swept(spark, d):
    return ev.sweep_thresholds(v.entries_golden(spark, d).select("label", F.col("p_window").alias("probability")))


@query(f"WITH {sv.GOLDEN}, {SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM sx")
def threshold_sweep(spark, d):
    return rounded(_swept(spark, d), "precision", "recall", "f1")


@query(f"WITH {sv.GOLDEN}, {SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM sx WHERE p >= 0.8 ORDER BY r DESC, threshold DESC LIMIT 1")
def chosen_threshold(spark, d):
    return rounded(ev.choose_threshold(_swept(spark, d)), "precision", "recall")


COND = "cd AS (SELECT *, 'window' AS condition, p_window AS p FROM g WHERE p_window IS NOT NULL UNION ALL SELECT *, 'function', p_function FROM g WHERE p_function IS NOT NULL), ch AS (SELECT *, CASE WHEN label = 'true_positive' THEN 1.0 ELSE 0.0 END AS y FROM cd WHERE labelled_by = 'human' AND label <> 'unsure')"


def _judged(spark, d):
    return ev.by_condition(ev.decided_by_human(v.entries_golden(spark, d))).withColumn("truth", F.col("label") == "true_positive")


@query(f"WITH {sv.GOLDEN}, {COND} SELECT condition, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM ch GROUP BY 1")
def brier_by_condition(spark, d):
    return rounded(_judged(spark, d).groupBy("condition").agg(F.count("*").alias("n"), ev.brier_score(F.col("p"), F.col("truth").cast("int")).alias("brier")), "brier")


RELY = "rl AS (SELECT condition, CAST(least(floor(p * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM ch GROUP BY 1, 2)"


def _reliable(spark, d):
    return ev.reliability(_judged(spark, d).withColumn("truth", F.col("truth").cast("int")), ["condition"])


@query(f"WITH {sv.GOLDEN}, {COND}, {RELY} SELECT condition, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM rl")
def reliability(spark, d):
    return rounded(_reliable(spark, d), "mean_p", "rate")


@query(f"WITH {sv.GOLDEN}, {COND}, {RELY} SELECT condition, round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM rl GROUP BY 1")
def ece(spark, d):
    return rounded(ev.expected_calibration_error(_reliable(spark, d), ["condition"]), "ece")


@query(f"WITH {sv.GOLDEN}, k AS (SELECT label AS a, CASE WHEN p_window >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS b FROM g WHERE p_window IS NOT NULL), n AS (SELECT count(*) AS n FROM k), e AS (SELECT sum(x.c * y.c) / (SELECT n * n FROM n) AS e FROM (SELECT a, count(*) AS c FROM k GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM k GROUP BY 1) y ON x.a = y.b), o AS (SELECT count(*) FILTER (WHERE a = b) / count(*) AS o FROM k) SELECT n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM n, e, o")
def kappa(spark, d):
    said = F.when(F.col("p_window") >= 0.5, "true_positive").otherwise("false_positive")
    rows = v.entries_golden(spark, d).where("p_window is not null").select("label", said.alias("said"))
    return rounded(ev.cohens_kappa(rows, "label", "said"), "agreement", "kappa")


@query(f"WITH {sv.GOLDEN} SELECT count(*) AS n FROM gp")
def paired_entries(spark, d):
    return ev.paired(v.entries_golden(spark, d)).agg(F.count("*").alias("n"))


ERRORS = "we AS (SELECT *, p_window >= 0.5 AS credulous FROM gp WHERE labelled_by = 'human' AND label <> 'unsure' AND (p_window >= 0.5) <> (p_function >= 0.5) AND (p_window >= 0.5) <> (label = 'true_positive'))"


@query(f"WITH {sv.GOLDEN}, {ERRORS} SELECT entry_id, credulous FROM we")
def window_errors(spark, d):
    return ev.window_errors(v.entries_golden(spark, d)).select("entry_id", "credulous")


def binomial(a: str, b: str) -> str:
    """SQL of the two-sided sign test of two counts."""
    return f"CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(least({a}, {b}) + 1 AS BIGINT)), lambda i: exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b} - 1) * ln(2))))) END"


@query(f"WITH {sv.GOLDEN}, x AS (SELECT rule_id, count(*) FILTER (WHERE p_function > p_window) AS more, count(*) FILTER (WHERE p_function < p_window) AS less FROM gp GROUP BY 1) SELECT rule_id, more, less, round({binomial('more', 'less')}, 6) AS p_value FROM x")
def sign_tests(spark, d):
    rows = ev.paired(v.entries_golden(spark, d)).groupBy("rule_id").agg(F.count_if(F.col("p_function") > F.col("p_window")).alias("more"), F.count_if(F.col("p_function") < F.col("p_window")).alias("less"))
    return rounded(rows.withColumn("p_value", ev.sign_test(F.col("more"), F.col("less"))), "p_value")


def bootstrap(rows: str, hit: str) -> str:
    """SQL of the cluster bootstrap over servers with 2000 replicates; its last table br has a value and a rank per replicate."""
    return f"bs AS (SELECT server_id AS c, count(*) FILTER (WHERE {hit}) AS a, count(*) AS n FROM {rows} GROUP BY 1), bn AS (SELECT *, row_number() OVER (ORDER BY sha256(c), c) - 1 AS i FROM bs), bk AS (SELECT count(*) AS k FROM bs), bd AS (SELECT rep, CAST('0x' || substr(sha256('7:' || rep || ':' || slot), 1, 8) AS BIGINT) % k AS i FROM bk, range(2000) r(rep), range(1, 1000) s(slot) WHERE slot <= k), bv AS (SELECT rep, sum(a) / sum(n) AS v FROM bd JOIN bn USING (i) GROUP BY 1), br AS (SELECT v, row_number() OVER (ORDER BY v, rep) - 1 AS rk FROM bv)"


BOOT = bootstrap("gp", "(p_window >= 0.5) <> (p_function >= 0.5)")


@query(f"WITH {sv.GOLDEN}, {ERRORS}, {bootstrap('we', 'credulous')}, x AS (SELECT count(*) AS n, count(*) FILTER (WHERE credulous) AS credulous FROM we) SELECT n, credulous, round(credulous / greatest(n, 1), 6) AS share, round({binomial('credulous', '(n - credulous)')}, 6) AS p_value, (SELECT round(max(v) FILTER (WHERE rk = 50), 6) FROM br) AS low, (SELECT round(max(v) FILTER (WHERE rk = 1949), 6) FROM br) AS high FROM x")
def credulous_report(spark, d):
    return rounded(ev.credulous_report(ev.window_errors(v.entries_golden(spark, d))), "share", "p_value", "low", "high")


@query(f"WITH {sv.GOLDEN}, {BOOT} SELECT round(max(v) FILTER (WHERE rk = 50), 6) AS low, round(max(v) FILTER (WHERE rk = 1949), 6) AS high FROM br")
def flip_ci(spark, d):
    return rounded(ev.cluster_bootstrap_ci(ev.paired(v.entries_golden(spark, d)), "server_id", go.verdicts_differ().cast("int")), "low", "high")


FLIP = "count(*) AS n, count(*) FILTER (WHERE (p_window >= 0.5) <> (p_function >= 0.5)) AS flips, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE (p_window >= 0.5) <> (p_function >= 0.5)) / count(*) ELSE 0.0 END, 6) AS share"


@query(f"WITH {sv.GOLDEN}, lg AS (SELECT server_id FROM gp WHERE (p_window >= 0.5) <> (p_function >= 0.5) GROUP BY 1 ORDER BY count(*) DESC, server_id LIMIT 1) SELECT 'all' AS over_servers, {FLIP} FROM gp UNION ALL SELECT 'without the largest', {FLIP} FROM gp WHERE server_id NOT IN (SELECT server_id FROM lg)")
def flip_estimate(spark, d):
    rows = v.entries_golden(spark, d)
    whole = ev.flip_share(rows).select(F.lit("all").alias("over_servers"), "n", "flips", "share")
    rest = ev.flip_share(ev.without_largest(rows)).select(F.lit("without the largest").alias("over_servers"), "n", "flips", "share")
    return rounded(whole.union(rest), "share")


DIS = "di AS (SELECT *, p_window >= 0.5 AS w, p_function >= 0.5 AS f, label = 'true_positive' AS t FROM gp WHERE (p_window >= 0.5) <> (p_function >= 0.5))"


@query(f"WITH {sv.GOLDEN}, {DIS} SELECT count(*) FILTER (WHERE w = t) AS window_right, count(*) FILTER (WHERE f = t) AS function_right FROM di WHERE labelled_by = 'human' AND label <> 'unsure'")
def side_counts(spark, d):
    return ev.side_counts(v.entries_golden(spark, d))


@query(f"WITH {sv.GOLDEN}, {DIS} SELECT count(*) FILTER (WHERE label = 'unsure') AS unsure, count(*) AS of_human FROM di WHERE labelled_by = 'human'")
def unsure_counts(spark, d):
    return ev.unsure_counts(v.entries_golden(spark, d))


@query(f"WITH {sv.GOLDEN}, {COND}, ct AS (SELECT entry_id FROM gp ORDER BY sha256('3:' || entry_id), entry_id LIMIT 60) SELECT condition, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM ch WHERE entry_id IN (SELECT entry_id FROM ct) GROUP BY 1")
def calibration_report(spark, d):
    control = sampling.hashed_draw(ev.paired(v.entries_golden(spark, d)), 60, 3, ["entry_id"]).select("entry_id")
    rows = _judged(spark, d).join(control, "entry_id", "left_semi")
    return rounded(rows.groupBy("condition").agg(F.count("*").alias("n"), ev.brier_score(F.col("p"), F.col("truth").cast("int")).alias("brier")), "brier")


OBSERVED = "os AS (SELECT entry_id, condition, CASE WHEN entry_id % 11 = 0 THEN 'unsure' WHEN p >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS label FROM cd)"


def _by_condition(spark, d):
    rows = ev.by_condition(v.entries_golden(spark, d))
    return rows.select("entry_id", "condition", F.when(F.col("entry_id") % 11 == 0, "unsure").when(F.col("p") >= 0.5, "true_positive").otherwise("false_positive").alias("label"))


@query(f"WITH {sv.GOLDEN}, {COND}, {OBSERVED} SELECT condition, count(*) AS n, count(*) FILTER (WHERE label <> 'unsure') AS decided, count(*) FILTER (WHERE label = 'unsure') AS unsure, count(*) FILTER (WHERE label = 'true_positive') AS true_positives, round(count(*) FILTER (WHERE label = 'true_positive') / nullif(count(*) FILTER (WHERE label <> 'unsure'), 0), 6) AS precision FROM os WHERE entry_id IN (SELECT entry_id FROM gp) GROUP BY 1")
def compare_conditions(spark, d):
    return rounded(ev.compare_conditions(_by_condition(spark, d)), "precision")


@query(f"WITH {sv.GOLDEN}, x AS (SELECT CASE WHEN abs(p_window - 0.5) < 0.2 THEN 'unsure' ELSE 'true_positive' END AS narrow, CASE WHEN abs(p_function - 0.5) < 0.1 THEN 'unsure' WHEN p_function >= 0.5 THEN 'true_positive' ELSE 'false_positive' END AS wide FROM gp) SELECT count(*) AS resolved, count(*) FILTER (WHERE wide = 'true_positive') AS true_positives, round(count(*) FILTER (WHERE wide = 'true_positive') / greatest(count(*), 1), 6) AS share FROM x WHERE narrow = 'unsure' AND wide <> 'unsure'")
def resolved_by_context(spark, d):
    rows = ev.paired(v.entries_golden(spark, d))
    narrow = F.when(F.abs(F.col("p_window") - 0.5) < 0.2, "unsure").otherwise("true_positive")
    wide = F.when(F.abs(F.col("p_function") - 0.5) < 0.1, "unsure").when(F.col("p_function") >= 0.5, "true_positive").otherwise("false_positive")
    return rounded(ev.resolved_by_context(rows.select(narrow.alias("narrow"), wide.alias("wide"))), "share")


@query(f"WITH {sv.GOLDEN}, x AS (SELECT rule_id, abs(p_window - 0.5) AS w, abs(p_function - 0.5) AS f FROM gp) SELECT rule_id, count(*) AS n, round(median(w), 6) AS median_window, round(median(f), 6) AS median_function, count(*) FILTER (WHERE f > w) AS more, count(*) FILTER (WHERE f < w) AS less, count(*) FILTER (WHERE f = w) AS tied, round({binomial('count(*) FILTER (WHERE f > w)', 'count(*) FILTER (WHERE f < w)')}, 6) AS p_value FROM x GROUP BY ROLLUP (rule_id)")
def decisiveness(spark, d):
    return rounded(ev.decisiveness(v.entries_golden(spark, d)), "median_window", "median_function", "p_value")


@query(f"WITH {sv.GOLDEN}, x AS (SELECT t, server_id, count(*) AS n, count(*) FILTER (WHERE (p_window >= t) <> (p_function >= t)) AS fl FROM gp, (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) v(t) GROUP BY 1, 2) SELECT t AS threshold, CAST(sum(fl) AS BIGINT) AS flips, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE fl > 0) AS servers, max(fl) AS largest, round(CASE WHEN sum(fl) > 0 THEN max(fl) / sum(fl) ELSE 0.0 END, 6) AS largest_share FROM x GROUP BY 1")
def flip_sensitivity(spark, d):
    return rounded(ev.flip_sensitivity(v.entries_golden(spark, d), [0.4, 0.5, 0.6, 0.7]), "largest_share")


@query(f"WITH {sv.GOLDEN}, {DIS} SELECT count(*) AS n, count(*) FILTER (WHERE w = t) AS window_right, count(*) FILTER (WHERE f = t) AS function_right, count(*) FILTER (WHERE w AND NOT t) AS window_credulous, count(*) FILTER (WHERE f AND NOT t) AS function_credulous, count(*) FILTER (WHERE NOT w AND t) AS window_missed, count(*) FILTER (WHERE NOT f AND t) AS function_missed, count(*) FILTER (WHERE t) AS vulnerable, count(DISTINCT server_id) AS servers FROM di WHERE labelled_by = 'human' AND label <> 'unsure'")
def truth_agreement(spark, d):
    return ev.truth_agreement(v.entries_golden(spark, d), "human").drop("p_value")


SECOND = "s2 AS (SELECT entry_id, condition, p, CASE WHEN entry_id % 4 = 0 THEN p ELSE 1 - p END AS q FROM cd WHERE entry_id % 9 <> 0)"


def _second(spark, d):
    rows = ev.by_condition(v.entries_golden(spark, d)).select("entry_id", "condition", "p", "server_id")
    return rows, rows.where("entry_id % 9 <> 0").withColumn("p", F.when(F.col("entry_id") % 4 == 0, F.col("p")).otherwise(1 - F.col("p")))


@query(f"WITH {sv.GOLDEN}, {COND}, {SECOND} SELECT condition, count(*) AS n, count(*) FILTER (WHERE (p >= 0.5) <> (q >= 0.5)) AS changes, count(*) FILTER (WHERE abs(p - q) = 0) AS identical, round(median(abs(p - q)), 6) AS median_shift, round(max(abs(p - q)), 6) AS max_shift FROM s2 GROUP BY 1")
def retest_stability(spark, d):
    return rounded(ev.retest_stability(*_second(spark, d)), "median_shift", "max_shift")


@query(f"WITH {sv.GOLDEN}, {DIS}, b AS (SELECT entry_id FROM gp WHERE (p_window >= 0.4) <> (p_function >= 0.6)), a AS (SELECT entry_id FROM di), c AS (SELECT count(*) FILTER (WHERE a.entry_id IS NOT NULL AND b.entry_id IS NOT NULL) AS \"both\", count(*) FILTER (WHERE b.entry_id IS NULL) AS only_first, count(*) FILTER (WHERE a.entry_id IS NULL) AS only_second FROM a FULL OUTER JOIN b ON a.entry_id = b.entry_id) SELECT *, round(CASE WHEN \"both\" + only_first + only_second > 0 THEN \"both\" / (\"both\" + only_first + only_second) ELSE 1.0 END, 6) AS jaccard FROM c")
def flip_overlap(spark, d):
    rows = ev.paired(v.entries_golden(spark, d))
    other = rows.where((F.col("p_window") >= 0.4) != (F.col("p_function") >= 0.6))
    return rounded(ev.flip_overlap(rows.where(go.verdicts_differ()), other), "jaccard")


@query(f"WITH {sv.GOLDEN} SELECT count(*) FILTER (WHERE p_function - p_window < 0) AS lower, count(*) FILTER (WHERE p_function - p_window > 0) AS higher, count(*) FILTER (WHERE p_function - p_window = 0) AS unchanged, round(median(p_function - p_window), 6) AS median_shift FROM gp")
def shift_summary(spark, d):
    return rounded(ev.shift_summary(v.entries_golden(spark, d)), "median_shift").drop("p_value")


@query(f"WITH {sv.GOLDEN}, {COND}, {SECOND} SELECT condition, count(*) AS n, count(*) FILTER (WHERE (p >= 0.5) = (q >= 0.5)) AS agree FROM s2 GROUP BY 1")
def judge_agreement(spark, d):
    first, second = _second(spark, d)
    both = first.join(second.select("entry_id", "condition", F.col("p").alias("q")), ["entry_id", "condition"])
    return both.groupBy("condition").agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == (F.col("q") >= 0.5)).alias("agree"))


