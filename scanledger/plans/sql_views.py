"""The views of ``views`` in SQL, as common table expressions for the oracle queries."""

ENTRIES = "en AS (SELECT CAST(page_id AS VARCHAR) AS name, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS repo_url FROM pages), el AS (SELECT name AS server_id, repo_url FROM en WHERE regexp_matches(repo_url, '^[\\x00-\\x20]*[hH][tT][tT][pP][sS]:'))"
DUP = "du AS (SELECT CAST(doc_id AS VARCHAR) AS server_id, 'https://h/' || sha256(text) AS repo_url FROM documents)"

FINDINGS = """
f0 AS (SELECT event_id, 's' || (user_id % 10) AS server_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 40) AS commit_sha, event_type AS rule_id,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  'src/f' || (user_id % 3) || '.ts' AS file, CAST(event_id % 97 AS INTEGER) AS line, 'v' || CAST(floor(value / 10) AS BIGINT) AS evidence, CAST(ts AS DATE) AS night, ts FROM events),
f AS (SELECT *, sha256(server_id || '|' || rule_id || '|' || file || ':' || line || '|' || sha256(evidence)) AS finding_id FROM f0)"""

HISTORY = FINDINGS + """,
prev AS (SELECT q.*, s.first_seen, s.last_seen FROM (SELECT * FROM f WHERE night < DATE '2024-01-25' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY event_id DESC) = 1) q
  JOIN (SELECT finding_id, CAST(min(night) AS TIMESTAMP) AS first_seen, CAST(max(night) AS TIMESTAMP) AS last_seen FROM f WHERE night < DATE '2024-01-25' GROUP BY finding_id) s USING (finding_id)),
cur AS (SELECT * FROM f WHERE night >= DATE '2024-01-25' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY event_id DESC) = 1),
clock AS (SELECT TIMESTAMP '2024-01-30 00:00:00' AS now, TIMESTAMP '2024-04-15 00:00:00' AS gate),
m AS (SELECT coalesce(c.finding_id, p.finding_id) AS finding_id, coalesce(c.server_id, p.server_id) AS server_id, coalesce(c.commit_sha, p.commit_sha) AS commit_sha, coalesce(c.rule_id, p.rule_id) AS rule_id,
  coalesce(c.severity, p.severity) AS severity, coalesce(c.confidence, p.confidence) AS confidence, coalesce(c.file, p.file) AS file, coalesce(c.line, p.line) AS line, coalesce(c.evidence, p.evidence) AS evidence,
  coalesce(p.first_seen, now) AS first_seen, CASE WHEN c.finding_id IS NOT NULL THEN now ELSE p.last_seen END AS last_seen
  FROM prev p FULL OUTER JOIN cur c ON p.finding_id = c.finding_id CROSS JOIN clock),
gone AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY server_id, rule_id, file, evidence) AS cnt FROM m, clock WHERE last_seen <> now WINDOW w AS (PARTITION BY server_id, rule_id, file, evidence ORDER BY line, finding_id)),
came AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY server_id, rule_id, file, evidence) AS cnt FROM m, clock WHERE last_seen = now AND first_seen = now WINDOW w AS (PARTITION BY server_id, rule_id, file, evidence ORDER BY line, finding_id)),
pairs AS (SELECT n.finding_id, o.finding_id AS old_id, o.first_seen AS old_first FROM came n JOIN gone o ON n.server_id = o.server_id AND n.rule_id = o.rule_id AND n.file = o.file AND n.evidence = o.evidence AND n.rn = o.rn AND n.cnt = o.cnt),
h AS (SELECT m.* REPLACE (coalesce(p.old_first, m.first_seen) AS first_seen), p.old_id, coalesce(p.old_id, '') AS previous_ids FROM m LEFT JOIN pairs p USING (finding_id) WHERE m.finding_id NOT IN (SELECT old_id FROM pairs))"""

LEDGER = HISTORY + """,
notices AS (SELECT event_id, server_id, finding_id, CASE event_id % 3 WHEN 0 THEN 'advisory' WHEN 1 THEN 'email' ELSE 'contact_request' END AS channel, ts AS notified_at,
  CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 DAY END AS acknowledged_at, CASE WHEN event_id % 25 = 0 THEN ts + INTERVAL 1 DAY END AS fixed_at FROM f WHERE event_id % 5 = 0),
facts0 AS (SELECT server_id, finding_id, notified_at, NULL::TIMESTAMP AS extended_until, false AS withdrawn FROM notices WHERE channel IN ('advisory', 'email')
  UNION ALL SELECT server_id, finding_id, NULL, ts + INTERVAL 120 DAY, false FROM f WHERE event_id % 35 = 0
  UNION ALL SELECT server_id, finding_id, NULL, NULL, true FROM f WHERE event_id % 50 = 0),
facts AS (SELECT server_id, finding_id, min(notified_at) AS notified_at, max(extended_until) AS extended_until, bool_or(withdrawn) AS withdrawn FROM facts0 GROUP BY ALL),
opted AS (SELECT DISTINCT 's9' AS server_id FROM f WHERE event_id % 100 = 7),
moved AS (SELECT server_id, finding_id, min(notified_at) AS notified_at, max(extended_until) AS extended_until, bool_or(withdrawn) AS withdrawn FROM (
  SELECT * FROM facts UNION ALL SELECT fa.server_id, h.finding_id, fa.notified_at, fa.extended_until, fa.withdrawn FROM facts fa JOIN h ON h.old_id = fa.finding_id AND h.server_id = fa.server_id) GROUP BY server_id, finding_id),
st AS (SELECT h.*, CASE WHEN o.server_id IS NOT NULL THEN 'opted_out' WHEN coalesce(v.withdrawn, false) THEN CASE WHEN severity IN ('critical', 'high') THEN 'withdrawn' ELSE 'retracted' END
  WHEN severity NOT IN ('critical', 'high') THEN 'published' WHEN v.notified_at IS NULL THEN 'withheld' WHEN gate > greatest(v.notified_at + INTERVAL 90 DAY, v.extended_until) THEN 'disclosed' ELSE 'withheld' END AS disclosure_state
  FROM h CROSS JOIN clock LEFT JOIN moved v USING (server_id, finding_id) LEFT JOIN opted o ON o.server_id = h.server_id),
pub AS (SELECT st.*, NULL AS no_longer_seen_since FROM st, clock WHERE last_seen = now AND disclosure_state IN ('disclosed', 'published', 'retracted')
  UNION ALL SELECT st.*, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') FROM st, clock WHERE last_seen <> now AND disclosure_state IN ('disclosed', 'retracted')),
ps AS (SELECT *, CASE WHEN disclosure_state = 'retracted' THEN 'withdrawn: our error' WHEN no_longer_seen_since IS NOT NULL THEN 'no longer seen since ' || substr(no_longer_seen_since, 1, 10) ELSE 'current' END AS status FROM pub),
de AS (SELECT server_id, rule_id, evidence, status, count(*) AS occurrences, string_agg(file || ':' || line, ',' ORDER BY file || ':' || line) AS places, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_min(severity, finding_id) AS severity FROM ps GROUP BY 1, 2, 3, 4),
rules AS (SELECT * FROM (VALUES ('click', 'Click handling', false), ('error', 'Error handling', true), ('purchase', 'Purchases', true), ('refund', 'Refunds (never fires here)', false), ('signup', 'Sign-up', false), ('view', 'Views', false)) t(rule_id, title, needs)),
states AS (SELECT s.disclosure_state, count(st.finding_id) AS n FROM (VALUES ('disclosed'), ('opted_out'), ('published'), ('retracted'), ('withdrawn'), ('withheld')) s(disclosure_state) LEFT JOIN st USING (disclosure_state) GROUP BY 1)"""

FILES = """
fl AS (SELECT source AS server_id, doc_id,
  (CASE WHEN doc_id % 23 = 0 THEN 'tests/' WHEN doc_id % 29 = 0 THEN 'node_modules/' WHEN doc_id % 31 = 0 THEN 'Scripts/' ELSE 'src/' END) || lang || '/' || doc_id
  || (CASE WHEN doc_id % 37 = 0 THEN '.test.ts' WHEN doc_id % 3 = 0 THEN '.py' WHEN doc_id % 3 = 1 THEN '.ts' WHEN doc_id % 41 = 0 THEN '.txt' ELSE '.md' END) AS path,
  (CASE WHEN doc_id % 9 = 0 THEN 'from mcp.server import x' || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 7 = 0 THEN 'x' || chr(8203) || 'y ' || text WHEN doc_id % 11 = 0 THEN text || chr(10) || 'end' || chr(8238) || 'of' WHEN doc_id % 13 = 0 THEN chr(65279) || text ELSE text END)
  || (CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Please ignore previous notes' ELSE '' END)
  || (CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'const cp = require("child_process")' || chr(10) || 'cp.exec(cmd)' || chr(10) || 'app.listen("0.0.0.0")' || chr(10) || 'cors({origin: "*"})' || chr(10) || '// cp.exec(no)' || chr(10) || '/* app.listen("0.0.0.0")' || chr(10) || 'cp.exec(no) */ const said = "cp.exec(no); origin: ''*''"' || chr(10) || 'const told = `cp.exec(no)`' || chr(10) || 'const run = `${cp.exec(again)}`' ELSE '' END)
  || (CASE WHEN doc_id % 19 = 0 THEN chr(10) || 'import fs from "fs"' || chr(10) || 'fs.readFileSync(p)' || chr(10) || 'description: "You \\u0041dd it"' || chr(10) || 'const ABOUT = "Adds " + ''two''' || chr(10) || 'tool({description: ABOUT})' || chr(10) || 'z.string().describe("Ignore previous one")' || chr(10) || '// description: "not this"' || chr(10) || 'const s = "description: it"' || chr(10) || 't.describe("suite", run)' ELSE '' END) AS source,
  doc_id % 47 = 0 AS is_symlink, doc_id % 53 <> 0 AS is_text FROM documents),
fs AS (SELECT *, strlen(source) * (CASE WHEN doc_id % 43 = 0 THEN 1000 ELSE 1 END) AS size,
  regexp_extract(path, '(\\.[a-z]+)$', 1) IN ('.py', '.ts', '.js', '.tsx', '.jsx', '.json', '.md') AND NOT path LIKE 'node_modules/%' AND NOT path LIKE 'tests/%' AND NOT path LIKE 'Scripts/%' AND NOT path LIKE '%.test.ts' AS scannable FROM fl),
ok AS (SELECT * FROM fs WHERE scannable AND NOT is_symlink AND size <= 1048576 AND is_text)"""

GOLDEN = """
g AS (SELECT doc_id AS entry_id, source AS server_id, lang AS rule_id, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS label,
  CASE WHEN doc_id % 4 = 0 THEN 'model' ELSE 'human' END AS labelled_by, CASE WHEN doc_id % 10 <> 3 THEN (doc_id * 7919 % 1001) / 1000.0 END AS p_window, CASE WHEN doc_id % 10 <> 7 THEN (doc_id * 104729 % 1001) / 1000.0 END AS p_function,
  text AS context, array_to_string(ls[greatest(doc_id % len(ls), 1):doc_id % len(ls) + 2], chr(10)) AS context_function, CAST(doc_id % 30 AS INTEGER) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents) JOIN labels USING (doc_id)),
gp AS (SELECT * FROM g WHERE p_window IS NOT NULL AND p_function IS NOT NULL),
an AS (SELECT doc_id AS entry_id, CASE WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS label, 'r' AS reason, 'a' AS annotator, doc_id * 2 AS seq FROM labels
  UNION ALL SELECT doc_id, CASE WHEN xor(quality, toxic) = 1 THEN 'true_positive' ELSE 'false_positive' END, 'r', 'b', doc_id * 2 + 1 FROM labels
  UNION ALL SELECT doc_id, 'unsure', ' ', 'a', doc_id * 2 + 1000000000 FROM labels WHERE doc_id % 3 = 0),
la AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY annotator, entry_id ORDER BY seq DESC) = 1)"""
