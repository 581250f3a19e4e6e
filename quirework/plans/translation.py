"""Queries over conversations and events: context windows, gates, assembly, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import n_tokens
from ..operators import assemble as A
from ..operators import context as X
from ..operators import quality as Q
from ..operators import state as S
from .tables import longs, md5, table, tokens_sql


def turns(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "role", "text")


def relevant_terms(spark, d):
    terms = table(spark, d, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("source")).distinct()
    short = table(spark, d, "documents", "text").select(F.explode(F.filter(F.split("text", " "), lambda w: F.length(w) == 3)).alias("source")).distinct()
    forms = terms.unionByName(short).distinct().select(F.col("source").alias("entity_id"), "source")
    docs = table(spark, d, "documents", "doc_id", "text")
    return X.relevant_entities(docs, forms, "doc_id", "text")


def rolling_window(spark, d):
    items = turns(spark, d).withColumn("tokens", n_tokens(F.col("text")))
    out = X.rolling_window(items, "conv_id", "turn", "text", "tokens", budget=400)
    return out.select("conv_id", "turn", F.col("window_size").cast("long").alias("window_size"), md5(F.col("window")).alias("window_md5"))


def overlap_prev(spark, d):
    chunks = turns(spark, d).select((F.col("conv_id") % 10).alias("book"), F.col("conv_id").alias("spine"), "turn", md5(F.col("text")).alias("head"))
    return X.overlap(chunks, "book", "spine", "turn", ["turn", "head"]).select("spine", "turn", F.coalesce("previous_turn", F.lit(-1)).alias("previous_turn"), "previous_head")


def overlap_within(spark, d):
    chunks = turns(spark, d).select((F.col("conv_id") % 10).alias("book"), F.col("conv_id").alias("spine"), "turn")
    return X.overlap(chunks, "book", "spine", "turn", ["turn"], across=False).select("spine", "turn", F.coalesce("previous_turn", F.lit(-1)).alias("previous_turn"))


def sequence_gate(spark, d):
    chunks = turns(spark, d).select((F.col("conv_id") % 10).alias("book"), F.col("conv_id").alias("spine"), "turn", F.when(F.col("conv_id") * 7 + F.col("turn") < 300, "completed").otherwise("pending").alias("status"))
    return X.ready(chunks, "book", "spine", "turn", "status").select("spine", "turn")


def answers(spark, d):
    """Each user turn with the assistant's turn after it."""
    t = turns(spark, d)
    q = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    return q.join(t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")), ["conv_id", "turn"])


def length_ratio_gate(spark, d):
    return answers(spark, d).select("conv_id", "turn", Q.length_gate(F.col("source"), F.col("output")).alias("gate"))


def analysis_strip(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    text = F.col("text")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("</analysis>\nx</analysis>\n "), text)).when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit("</analysis>"), text)).otherwise(F.col("text"))
    out = Q.analysis(answer)
    return docs.select("doc_id", out["has_boundary"].alias("has_boundary"), md5(F.coalesce(out["analysis"], F.lit("none"))).alias("analysis_md5"), md5(out["text"]).alias("text_md5"))


def qa_verdict(spark, d):
    a = answers(spark, d)
    gate = Q.length_gate(F.col("source"), F.col("output"))
    severity = F.when(F.col("conv_id") % 3 == 0, "high").when(F.col("conv_id") % 3 == 1, "low").otherwise("medium")
    issues = F.when(F.col("conv_id") % 7 == 0, None).otherwise(F.array(F.struct(F.lit("style").alias("issue"), F.lit("low").alias("severity")), F.struct(F.lit("tone").alias("issue"), severity.alias("severity"))))
    return a.select("conv_id", "turn", Q.verdict(gate, issues).alias("verdict"))


def attempt_select(spark, d):
    attempts = turns(spark, d).select("conv_id", F.col("turn").alias("attempt"), F.length("text").alias("n_issues"))
    return longs(Q.selected_attempts(attempts, "conv_id", "attempt").select("conv_id", "attempt", "n_issues", "total_attempts"))


def attempt_next(spark, d):
    return longs(Q.next_attempt(turns(spark, d), "conv_id", "turn"))


def message_build(spark, d):
    a = answers(spark, d)
    glossary = F.when(F.col("conv_id") % 2 == 0, F.lit("terms"))
    summary = F.when(F.col("turn") > 1, F.lit("so far"))
    m = Q.message_array(system=F.lit("Translate."), glossary=glossary, summary=summary, source=F.col("source"))
    return a.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), md5(x["content"]))), "|").alias("messages"))


def range_filter(spark, d):
    counts = turns(spark, d).groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    ids = X.chunk_ids(counts, "conv_id", "n")
    return longs(ids.where(((F.col("conv_id") > 3) | (F.col("chunk_index") >= 2)) & (F.col("conv_id") >= 3) & (F.col("conv_id") <= 20)))


def token_usage(spark, d):
    t = turns(spark, d).select("conv_id", "role", n_tokens(F.col("text")).alias("n"))
    return t.groupBy("role").agg(F.sum("n").cast("long").alias("total"), F.round(F.avg("n"), 6).alias("average"))


def summary_upsert(spark, d):
    rows = turns(spark, d).select("conv_id", "role", "turn", F.col("text").alias("summary"))
    return X.latest(rows, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "summary")


def assemble_text(spark, d):
    out = A.assembled(turns(spark, d), "conv_id", "turn", "text")
    return out.select("conv_id", md5(F.col("text")).alias("text_md5"), F.col("n_parts").cast("long").alias("n_parts"))


def assemble_complete(spark, d):
    t = turns(spark, d)
    expected = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    out = A.assembled(t.where((F.col("conv_id") % 5 != 0) | (F.col("turn") != 1)), "conv_id", "turn", "text", expected, "n")
    return out.select("conv_id", F.col("n_parts").cast("long").alias("n_parts"), "complete", md5(F.coalesce("text", F.lit("deferred"))).alias("text_md5"))


def missing_parts(spark, d):
    t = turns(spark, d).select("conv_id", "turn")
    return A.missing_parts(t, t.where((F.col("conv_id") % 5 != 0) | (F.col("turn") != 1)), ["conv_id", "turn"])


def css_strip(spark, d):
    css = F.concat(F.lit("p { color: red;\n  -webkit-Writing-Mode : vertical-rl ;\n writing-mode:tb-rl; }\n/* "), F.col("doc_id"), F.lit(" */ -epub-writing-mode: x; a { writing-mode: y }"))
    return table(spark, d, "documents", "doc_id").select("doc_id", A.without_declarations(css).alias("css"))


def title_dedupe(spark, d):
    titles = table(spark, d, "pages", "page_id", "html").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return A.distinct_titles(titles, "title", "page_id")


def event_log(spark, d):
    """Events as a log: users are items of the stage that a third of them is in."""
    kind = F.create_map(*[F.lit(x) for kv in {"click": "started", "view": "started", "signup": "pending", "error": "failed", "purchase": "completed"}.items() for x in kv])
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "props")
    return e.select(F.concat(F.lit("stage"), F.col("user_id") % 3).alias("stage"), F.concat(F.lit("u"), F.col("user_id")).alias("item_id"), kind[F.col("event_type")].alias("status"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", F.concat(F.repeat(F.lit("e"), 120), F.col("event_id"))).alias("error_message"), F.col("event_id").alias("seq"))


def latest_state(spark, d):
    return S.latest_state(event_log(spark, d)).select("stage", "item_id", "status", F.coalesce("completed_at", F.lit(-1)).alias("completed_at"))


def stage_status(spark, d):
    return S.stage_status(S.latest_state(event_log(spark, d)))


def pending_items(spark, d):
    items = table(spark, d, "events", "user_id").distinct().select(F.concat(F.lit("u"), F.col("user_id")).alias("item_id"))
    return S.pending(items, S.latest_state(event_log(spark, d)), "stage1")


def state_failures(spark, d):
    return S.failures(S.latest_state(event_log(spark, d))).select("stage", "item_id", "status", "error_message")


def json_recover(spark, d):
    e = table(spark, d, "events", "event_id", "props")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('I think {"no": 1} or "}" so: '), F.col("props"), F.lit(" done"))).otherwise(F.col("props"))
    return e.select("event_id", Q.parsed(answer, "k bigint")["k"].alias("k"))


def markdown_to_html(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", A.to_html("text").alias("html"))


QUERIES = {f.__name__: f for f in (
    relevant_terms, rolling_window, overlap_prev, overlap_within, sequence_gate, length_ratio_gate, analysis_strip, qa_verdict, attempt_select, attempt_next, message_build, range_filter, token_usage,
    summary_upsert, assemble_text, assemble_complete, missing_parts, css_strip, title_dedupe, latest_state, stage_status, pending_items, state_failures, json_recover, markdown_to_html,
)}

ANSWERS = "an AS (SELECT q.conv_id, q.turn, q.text AS source, a.text AS output FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"
GATE = f"CASE WHEN {tokens_sql('source')} = 0 THEN 'skipped' WHEN {tokens_sql('output')} / {tokens_sql('source')} < 0.3 THEN 'short' WHEN {tokens_sql('output')} / {tokens_sql('source')} > 2.0 THEN 'long' ELSE 'ok' END"
LOG = """l AS (SELECT 'stage' || user_id % 3 AS stage, 'u' || user_id AS item_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'started' END AS status, event_id AS seq FROM events),
g AS (SELECT stage, item_id, max(seq) FILTER (status = 'failed') AS f, max(seq) FILTER (status = 'completed') AS c, arg_max(status, seq) AS last FROM l GROUP BY ALL),
s AS (SELECT stage, item_id, CASE WHEN c IS NOT NULL AND (f IS NULL OR c > f) THEN 'completed' ELSE last END AS status, CASE WHEN c IS NOT NULL AND (f IS NULL OR c > f) THEN c END AS completed_at, f FROM g)"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format

ORACLE = {
    "relevant_terms": r"""WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) = 3), f AS (SELECT w FROM t UNION SELECT w FROM s)
SELECT doc_id, w AS entity_id FROM documents JOIN f ON contains(text, w)""",
    "rolling_window": f"""WITH c AS (SELECT *, {tokens_sql('text')} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), p AS (SELECT a.conv_id, a.turn, b.turn AS bt, b.text, a.i - b.i AS away, sum(b.n) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS s FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn < a.turn),
k AS (SELECT conv_id, turn, count(*) AS w, string_agg(text, chr(10) || '---' || chr(10) ORDER BY bt) AS t FROM p WHERE s <= 400 OR away = 1 GROUP BY ALL) SELECT c.conv_id, c.turn, coalesce(w, 0) AS window_size, md5(coalesce(t, '')) AS window_md5 FROM c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn""",
    "overlap_prev": "SELECT conv_id AS spine, turn, coalesce(lag(turn) OVER w, -1) AS previous_turn, lag(md5(text)) OVER w AS previous_head FROM conversations WINDOW w AS (PARTITION BY conv_id % 10 ORDER BY conv_id, turn)",
    "overlap_within": "SELECT conv_id AS spine, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS previous_turn FROM conversations",
    "sequence_gate": "SELECT spine, turn FROM (SELECT conv_id AS spine, turn, conv_id * 7 + turn < 300 AS done, lag(conv_id * 7 + turn < 300) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS before FROM conversations) WHERE NOT done AND coalesce(before, true)",
    "length_ratio_gate": f"WITH {ANSWERS} SELECT conv_id, turn, {GATE} AS gate FROM an",
    "analysis_strip": rf"""WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || '</analysis>' || chr(10) || 'x</analysis>' || chr(10) || ' ' || text WHEN 1 THEN text || '</analysis>' || text ELSE text END AS t FROM documents)
SELECT doc_id, contains(t, '</analysis>') AS has_boundary, md5(CASE WHEN contains(t, '</analysis>') THEN regexp_extract(t, '(?s)^(.*</analysis>)(.*)$', 1) ELSE 'none' END) AS analysis_md5, md5(CASE WHEN contains(t, '</analysis>') THEN {STRIP("list_last(string_split(t, '</analysis>'))")} ELSE t END) AS text_md5 FROM a""",
    "qa_verdict": f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN {GATE} IN ('short', 'long') OR conv_id % 7 = 0 OR conv_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM an",
    "attempt_select": "SELECT conv_id, max(turn) AS attempt, arg_max(length(text), turn) AS n_issues, count(*) AS total_attempts FROM conversations GROUP BY conv_id",
    "attempt_next": "SELECT conv_id, max(turn) + 1 AS next_attempt FROM conversations GROUP BY conv_id",
    "message_build": f"WITH {ANSWERS} SELECT conv_id, turn, 'system=' || md5('Translate.') || CASE WHEN conv_id % 2 = 0 THEN '|user=' || md5('terms') || '|assistant=' || md5('Understood.') ELSE '' END || CASE WHEN turn > 1 THEN '|user=' || md5('so far') || '|assistant=' || md5('Understood.') ELSE '' END || '|user=' || md5(source) AS messages FROM an",
    "range_filter": "SELECT conv_id, unnest(range(1, n + 1)) AS chunk_index FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id BETWEEN 4 AND 20 GROUP BY conv_id) UNION ALL SELECT conv_id, i FROM (SELECT conv_id, unnest(range(1, n + 1)) AS i FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id = 3 GROUP BY conv_id)) WHERE i >= 2",
    "token_usage": f"SELECT role, sum({tokens_sql('text')})::BIGINT AS total, round(avg({tokens_sql('text')}), 6) AS average FROM conversations GROUP BY role",
    "summary_upsert": "SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id, role",
    "assemble_text": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS n_parts FROM conversations GROUP BY conv_id",
    "assemble_complete": "SELECT conv_id, count(*) FILTER (kept) AS n_parts, bool_and(kept) AS complete, md5(CASE WHEN bool_and(kept) THEN string_agg(text, chr(10) || chr(10) ORDER BY turn) ELSE 'deferred' END) AS text_md5 FROM (SELECT *, conv_id % 5 <> 0 OR turn <> 1 AS kept FROM conversations) GROUP BY conv_id",
    "missing_parts": "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 1",
    "css_strip": r"SELECT doc_id, 'p { color: red;' || chr(10) || ' }' || chr(10) || '/* ' || doc_id || ' */ a { writing-mode: y }' AS css FROM documents",
    "title_dedupe": "SELECT title, min(page_id) AS ord FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) GROUP BY title",
    "latest_state": f"WITH {LOG} SELECT stage, item_id, status, coalesce(completed_at, -1) AS completed_at FROM s",
    "stage_status": f"WITH {LOG} SELECT stage, count(*) AS n_items, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'started') AS n_started, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed FROM s GROUP BY stage",
    "pending_items": f"WITH {LOG} SELECT DISTINCT 'u' || user_id AS item_id FROM events WHERE 'u' || user_id NOT IN (SELECT item_id FROM s WHERE stage = 'stage1' AND status = 'completed')",
    "state_failures": f"WITH {LOG} SELECT stage, item_id, status, CASE WHEN status = 'failed' THEN repeat('e', 97) || '...' END AS error_message FROM s WHERE status <> 'completed'",
    "json_recover": """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""",
}
