"""Queries over documents and pages: cleaning, classifying, cutting, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as T
from ..operators import classify as K
from ..operators import packing, segment
from .tables import bounded_batches, longs, md5, table, tokens_sql

TAIL = "\n\n---\nword\n***\n\n＊＊＊\n* * *\n tail\n#tag\n\n"
CHUNKS = segment.Chunking(target=120, most=150, least=30, flex=0.3)


def markdown(spark, d):
    """Documents as markdown: a heading, each line a paragraph, and some breaks at the end."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.concat(F.lit("# Doc "), F.col("doc_id"), F.lit("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit(TAIL)).alias("md"))


def block_parse(spark, d):
    return longs(segment.parse_blocks(markdown(spark, d), "doc_id", "md").select("doc_id", "block_index", "kind", md5(F.col("text")).alias("text_md5"), "token_count"))


def block_kind_counts(spark, d):
    return segment.parse_blocks(markdown(spark, d), "doc_id", "md").groupBy("kind").agg(F.count("*").alias("n_blocks"), F.sum("token_count").cast("long").alias("n_tokens"))


def chunk_greedy(spark, d):
    return longs(segment.chunk_documents(markdown(spark, d), "doc_id", "md", CHUNKS).select("doc_id", "chunk_index", "block_start", "block_end", "token_count", "extended_for_remainder"))


def chunk_materialize(spark, d):
    chunks = segment.with_chunk_ids(segment.chunk_documents(markdown(spark, d), "doc_id", "md", CHUNKS), "doc_id")
    return chunks.select("chunk_id", "ends_at_scene_break", md5(F.col("text")).alias("text_md5"))


def chunk_coverage_check(spark, d):
    md = markdown(spark, d)
    return longs(segment.coverage(segment.parse_blocks(md, "doc_id", "md"), segment.chunk_documents(md, "doc_id", "md", CHUNKS), "doc_id"))


def classified(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("chapter", "illustration", "unknown", "toc_auto", "cover")])
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.withColumn("classification", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))


def eligible_filter(spark, d):
    return segment.eligible(segment.require_classified(classified(spark, d), "classification"), "classification").select("doc_id", "classification")


def corpus_totals(spark, d):
    docs = table(spark, d, "documents", "text").select(T.n_tokens(F.col("text")).alias("n"))
    return docs.agg(F.count("*").alias("n_documents"), F.sum("n").cast("long").alias("n_tokens"))


def packed(target, least, redistribute):
    def query(spark, d):
        items = table(spark, d, "documents", "doc_id", "source", "text").select("source", "doc_id", T.n_tokens(F.col("text")).alias("tokens"))
        out = packing.batches(items, "source", "doc_id", "tokens", target=target, least=least, redistribute=redistribute)
        return longs(out.select("source", "batch_no", "first_item", "last_item", "token_count"))

    return query


def batch_render(spark, d):
    turns = table(spark, d, "conversations", "conv_id", "turn", "text")
    chunks = turns.select(packing.item_id(F.col("conv_id"), F.lit(1)).alias("batch_id"), T.chunk_id(F.col("conv_id"), F.col("turn") + 1).alias("chunk_id"), "text")
    return packing.batch_text(chunks, "batch_id", "chunk_id", "text").select("batch_id", md5(F.col("text")).alias("text_md5"))


def pages(spark, d):
    return table(spark, d, "pages", "page_id", "html")


def visible_text(spark, d):
    return pages(spark, d).select("page_id", md5(K.visible_text(F.col("html"))).alias("text_md5"), F.length(K.visible_text(F.col("html"))).cast("long").alias("n_chars"))


def headings(spark, d):
    return longs(pages(spark, d).select("page_id", F.posexplode(K.headings(F.col("html"))).alias("place", "heading")))


def non_heading_words(spark, d):
    return pages(spark, d).select("page_id", K.n_words(K.text_without_headings(F.col("html"))).cast("long").alias("n_words"))


#: Pages cut down so that every rule has some: a contents list, a picture, a bare heading, and whole pages.
def derived_pages(spark, d):
    h, m = F.col("html"), F.col("page_id") % 4
    bare = F.concat(F.lit("<h2>Part <b>"), F.col("page_id"), F.lit("</b></h2><p>few words</p>"))
    return pages(spark, d).select("page_id", F.when(m == 0, F.concat(F.lit('<nav epub:type="toc">'), h, F.lit("</nav>"))).when(m == 1, F.concat(F.lit("<p>"), F.col("page_id"), F.lit('</p><img src="a.png"/>'))).when(m == 2, bare).otherwise(h).alias("html"), F.when(F.col("page_id") % 10 == 0, "chapter").alias("given"))


def rule_classify(spark, d):
    return K.classify(derived_pages(spark, d), "html", given="given").select("page_id", "classification", "title")


def class_counts(spark, d):
    return rule_classify(spark, d).groupBy(F.coalesce("classification", F.lit("needs_model")).alias("classification")).agg(F.count("*").alias("n"))


def whitespace_normalize(spark, d):
    text = F.concat(F.lit("\n\n "), F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\n\n\n\n")), F.lit("  \n\n"))
    out = T.normal_markdown(text)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", md5(out).alias("text_md5"), F.length(out).cast("long").alias("n_chars"))


def paragraph_count(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.n_paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).cast("long").alias("n_paragraphs"))


def html_to_markdown(spark, d):
    bounded_batches(spark)
    return pages(spark, d).select("page_id", markup.to_markdown("html").alias("markdown"))


def token_truncate(spark, d):
    out = T.truncated_tokens(F.col("text"), 50)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", md5(out).alias("text_md5"), T.n_tokens(out).cast("long").alias("n_tokens"))


def word_truncate(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.truncated_words(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 60).alias("summary"))


QUERIES = {
    "block_parse": block_parse, "block_kind_counts": block_kind_counts, "chunk_greedy": chunk_greedy, "chunk_materialize": chunk_materialize,
    "chunk_coverage_check": chunk_coverage_check, "eligible_filter": eligible_filter, "corpus_totals": corpus_totals,
    "batch_pack": packed(4000, 0, 0.0), "batch_absorb": packed(4000, 1500, 0.0), "batch_rebalance": packed(4000, 200, 0.6), "batch_render": batch_render,
    "visible_text": visible_text, "headings": headings, "non_heading_words": non_heading_words, "rule_classify": rule_classify, "class_counts": class_counts,
    "whitespace_normalize": whitespace_normalize, "paragraph_count": paragraph_count, "html_to_markdown": html_to_markdown, "token_truncate": token_truncate, "word_truncate": word_truncate,
}

NL = "chr(10)"
SQL_TAIL = "||".join(f"'{p}'" if p else "''" for p in TAIL.split("\n")).replace("||", f"||{NL}||")
SQL_LINES = rf"""
WITH RECURSIVE src AS (SELECT doc_id, string_split('# Doc ' || doc_id || {NL} || replace(text, {NL}, {NL} || {NL}) || {SQL_TAIL}, {NL}) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM src),
kinds AS (SELECT doc_id, n, regexp_replace(l, '[ \t]+$', '') AS l, CASE WHEN regexp_matches(l, '^\s*$') THEN 'blank' WHEN regexp_matches(l, '^\s*#') THEN 'heading'
  WHEN regexp_matches(l, '^\s*[-*_](\s*[-*_]){{2,}}\s*$') THEN 'hr' ELSE 'text' END AS k FROM lines),
starts AS (SELECT *, CASE WHEN k = 'text' AND lag(k) OVER (PARTITION BY doc_id ORDER BY n) = 'text' THEN 0 ELSE 1 END AS s FROM kinds),
runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM starts),
joined AS (SELECT doc_id, g, min(k) AS k, string_agg(l, {NL} ORDER BY n) AS t FROM runs WHERE k <> 'blank' GROUP BY doc_id, g),
named AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block_index,
  CASE WHEN k = 'text' THEN CASE WHEN regexp_matches(t, '^\s*(＊{{3,}}|◇{{3,}}|・{{3,}}|×(\s*×)+|─{{4,}})\s*$') THEN 'scene_break' ELSE 'paragraph' END ELSE k END AS kind, t FROM joined),
blocks AS (SELECT doc_id, block_index, kind, CASE WHEN kind IN ('hr', 'scene_break') THEN '* * *' ELSE t END AS text FROM named),
b AS (SELECT *, {tokens_sql("text")} AS tokens, kind IN ('hr', 'scene_break', 'heading') AS brk FROM blocks)
"""
LOW, TARGET, LEAST = CHUNKS.target * (1 - CHUNKS.flex), CHUNKS.target, CHUNKS.least
SQL_CHUNKS = rf"""{SQL_LINES},
st AS (
  SELECT doc_id, 0::BIGINT AS i, tokens AS cur, 0::BIGINT AS first, CASE WHEN brk AND tokens BETWEEN {LOW} AND {TARGET} THEN 0 ELSE -1 END::BIGINT AS best,
    CASE WHEN brk AND tokens BETWEEN {LOW} AND {TARGET} THEN tokens ELSE 0 END::BIGINT AS best_sum, NULL::BIGINT AS cut FROM b WHERE block_index = 0
  UNION ALL
  SELECT doc_id, i, ncur, nfirst, CASE WHEN brk AND ncur BETWEEN {LOW} AND {TARGET} THEN i WHEN is_full THEN -1 ELSE best END,
    CASE WHEN brk AND ncur BETWEEN {LOW} AND {TARGET} THEN ncur WHEN is_full THEN 0 ELSE best_sum END, CASE WHEN is_full THEN pos END
  FROM (SELECT *, CASE WHEN NOT is_full THEN cur + tokens WHEN best >= 0 THEN cur - best_sum + tokens ELSE tokens END AS ncur, CASE WHEN is_full THEN pos + 1 ELSE first END AS nfirst
    FROM (SELECT st.doc_id, b.block_index AS i, b.tokens, b.brk, st.cur, st.first, st.best, st.best_sum, b.block_index > st.first AND st.cur + b.tokens > {TARGET} AS is_full,
      CASE WHEN st.best >= 0 THEN st.best ELSE b.block_index - 1 END AS pos FROM st JOIN b ON b.doc_id = st.doc_id AND b.block_index = st.i + 1))),
final AS (SELECT doc_id, max(i) AS last, max_by(cur, i) AS cur, count(cut) AS cuts, max(cut) AS last_cut FROM st GROUP BY doc_id),
ends AS (SELECT st.doc_id, st.cut AS e FROM st JOIN final f USING (doc_id) WHERE st.cut IS NOT NULL AND NOT (f.cur < {LEAST} AND st.cut = f.last_cut)
  UNION ALL SELECT doc_id, last FROM final),
chunks AS (SELECT ends.doc_id, row_number() OVER (PARTITION BY ends.doc_id ORDER BY e) AS chunk_index, coalesce(lag(e) OVER (PARTITION BY ends.doc_id ORDER BY e) + 1, 0) AS block_start, e AS block_end,
  f.cuts > 0 AND f.cur < {LEAST} AND e = f.last AS extended_for_remainder FROM ends JOIN final f ON f.doc_id = ends.doc_id),
whole AS (SELECT c.doc_id, c.chunk_index, c.block_start, c.block_end, c.extended_for_remainder, sum(tokens)::BIGINT AS token_count, string_agg(text, {NL} || {NL} ORDER BY block_index) AS text, max_by(kind, block_index) AS last_kind
  FROM chunks c JOIN b ON b.doc_id = c.doc_id AND b.block_index BETWEEN c.block_start AND c.block_end GROUP BY ALL)
"""


def pack_sql(target: int, least: int, redistribute: float) -> str:
    return rf"""
WITH RECURSIVE it AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, {tokens_sql("text")} AS t FROM documents),
st AS (SELECT source, n, t, t AS cur, 1::BIGINT AS batch FROM it WHERE n = 1
  UNION ALL SELECT st.source, it.n, it.t, CASE WHEN st.cur + it.t > {target} THEN it.t ELSE st.cur + it.t END, CASE WHEN st.cur + it.t > {target} THEN st.batch + 1 ELSE st.batch END
  FROM st JOIN it ON it.source = st.source AND it.n = st.n + 1),
sums AS (SELECT source, batch, sum(t) AS total FROM st GROUP BY ALL),
last AS (SELECT source, max(batch) AS k, max_by(total, batch) AS total FROM sums GROUP BY source),
two AS (SELECT st.source, st.n, st.t, sum(st.t) OVER (PARTITION BY st.source ORDER BY st.n) AS l, sum(st.t) OVER (PARTITION BY st.source) AS whole, max(st.n) OVER (PARTITION BY st.source) AS top FROM st JOIN last USING (source) WHERE st.batch >= last.k - 1),
cut AS (SELECT source, arg_min(n, struct_pack(d := abs(2 * l - whole), n := n)) AS at FROM two WHERE n < top GROUP BY source),
placed AS (SELECT st.source, st.n, st.t, CASE WHEN l.k > 1 AND st.batch >= l.k - 1 AND l.total < {least} THEN l.k - 1
  WHEN l.k > 1 AND st.batch >= l.k - 1 AND l.total < {redistribute * target} THEN CASE WHEN st.n <= c.at THEN l.k - 1 ELSE l.k END ELSE st.batch END AS batch_no
  FROM st JOIN last l USING (source) LEFT JOIN cut c USING (source))
SELECT source, batch_no, min(n) AS first_item, max(n) AS last_item, sum(t)::BIGINT AS token_count FROM placed GROUP BY source, batch_no"""


WS = r"[\s\x{A0}\x{3000}]"
H = "(?is)" + "|".join(f"<h{n}(?:\\s[^>]*)?>(.*?)</h{n}>" for n in range(1, 7))


def collapse_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


SQL_HEADINGS = rf"""list_filter(list_transform(regexp_extract_all(html, '{H}'), lambda h: {collapse_sql("h")}), lambda h: length(h) > 0)"""
SQL_REST = collapse_sql(f"regexp_replace(html, '{H}', ' ', 'g')")
SQL_WORDS = f"CASE WHEN length({SQL_REST}) = 0 THEN 0 ELSE len(string_split({SQL_REST}, ' ')) END::BIGINT"
SQL_DERIVED = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<nav epub:type="toc">' || html || '</nav>' WHEN 1 THEN '<p>' || page_id || '</p><img src="a.png"/>' WHEN 2 THEN '<h2>Part <b>' || page_id || '</b></h2><p>few words</p>' ELSE html END AS html,
  CASE WHEN page_id % 10 = 0 THEN 'chapter' END AS given FROM pages"""
SQL_RULES = rf"""WITH p AS ({SQL_DERIVED}), f AS (SELECT page_id, given, html, {SQL_HEADINGS} AS hs, {SQL_WORDS} AS w, {tokens_sql(collapse_sql("html"))} AS t FROM p),
r AS (SELECT page_id, given, CASE WHEN html LIKE '%epub:type="toc"%' THEN 'toc_auto' WHEN t < 30 AND html LIKE '%<img%' THEN 'illustration' WHEN len(hs) > 0 AND w < 10 THEN 'frontmatter' END AS rule, hs FROM f),
c AS (SELECT page_id, coalesce(given, rule) AS classification, CASE rule WHEN 'toc_auto' THEN 'Table of Contents' WHEN 'frontmatter' THEN hs[1] END AS title FROM r)"""

ORACLE = {
    "block_parse": SQL_LINES + "SELECT doc_id, block_index, kind, md5(text) AS text_md5, tokens AS token_count FROM b",
    "block_kind_counts": SQL_LINES + "SELECT kind, count(*) AS n_blocks, sum(tokens)::BIGINT AS n_tokens FROM b GROUP BY kind",
    "chunk_greedy": SQL_CHUNKS + "SELECT doc_id, chunk_index, block_start, block_end, token_count, extended_for_remainder FROM whole",
    "chunk_materialize": SQL_CHUNKS + "SELECT printf('%04d.%03d', doc_id, chunk_index) AS chunk_id, last_kind IN ('hr', 'scene_break') AS ends_at_scene_break, md5(text) AS text_md5 FROM whole",
    "chunk_coverage_check": SQL_CHUNKS + """, x AS (SELECT doc_id, sum(token_count)::BIGINT AS ct, count(*) AS n, max(chunk_index) AS top FROM whole GROUP BY doc_id),
y AS (SELECT b.doc_id, count(*) FILTER (c.doc_id IS NULL) AS uncovered, count(*) - count(DISTINCT b.block_index) AS repeated FROM b LEFT JOIN chunks c ON c.doc_id = b.doc_id AND b.block_index BETWEEN c.block_start AND c.block_end GROUP BY b.doc_id),
z AS (SELECT doc_id, sum(tokens)::BIGINT AS bt FROM b GROUP BY doc_id)
SELECT doc_id, uncovered, repeated, 0::BIGINT AS "unknown", top - n AS misnumbered, bt AS block_tokens, ct AS chunk_tokens, uncovered = 0 AND repeated = 0 AND top = n AND bt = ct AS "valid" FROM x JOIN y USING (doc_id) JOIN z USING (doc_id)""",
    "eligible_filter": "SELECT doc_id, classification FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'chapter' WHEN 1 THEN 'illustration' WHEN 2 THEN 'unknown' WHEN 3 THEN 'toc_auto' ELSE 'cover' END AS classification FROM documents) WHERE classification IN ('chapter', 'frontmatter', 'backmatter', 'toc_authored', 'toc_auto', 'unknown')",
    "corpus_totals": f"SELECT count(*) AS n_documents, sum({tokens_sql('text')})::BIGINT AS n_tokens FROM documents",
    "batch_pack": pack_sql(4000, 0, 0.0), "batch_absorb": pack_sql(4000, 1500, 0.0), "batch_rebalance": pack_sql(4000, 200, 0.6),
    "batch_render": f"SELECT printf('%04d.b%d', conv_id, 1) AS batch_id, md5(string_agg('--- chunk ' || printf('%04d.%03d', conv_id, turn + 1) || ' ---' || {NL} || text, {NL} || {NL} ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
    "visible_text": f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {collapse_sql('html')} AS t FROM pages)",
    "headings": f"SELECT page_id, generate_subscripts(hs, 1) - 1 AS place, unnest(hs) AS heading FROM (SELECT page_id, {SQL_HEADINGS} AS hs FROM pages)",
    "non_heading_words": f"SELECT page_id, {SQL_WORDS} AS n_words FROM pages",
    "rule_classify": SQL_RULES + " SELECT * FROM c",
    "class_counts": SQL_RULES + " SELECT coalesce(classification, 'needs_model') AS classification, count(*) AS n FROM c GROUP BY 1",
    "whitespace_normalize": rf"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace({NL} || {NL} || ' ' || replace(text, {NL}, ' ' || chr(9) || {NL} || {NL} || {NL} || {NL}) || '  ' || {NL} || {NL}, '\n{{3,}}', {NL} || {NL}, 'g'), {NL}), lambda x: regexp_replace(x, '[ \t]+$', '')), {NL}), '^\s+|\s+$', '', 'g') || {NL} AS t FROM documents)""",
    "paragraph_count": f"SELECT doc_id, len(list_filter(string_split(text, {NL}), lambda x: length(trim(x)) > 0))::BIGINT AS n_paragraphs FROM documents",
    "token_truncate": rf"SELECT doc_id, md5(t) AS text_md5, {tokens_sql('t')} AS n_tokens FROM (SELECT doc_id, CASE WHEN {tokens_sql('text')} <= 50 THEN text ELSE regexp_extract(text, '(?s)^((?:\s*(?:[A-Za-z0-9À-ɏ]+|[^\sA-Za-z0-9À-ɏ])){{0,50}})', 1) END AS t FROM documents)",
    "word_truncate": f"SELECT doc_id, CASE WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '...' ELSE t END AS summary FROM (SELECT doc_id, replace(text, {NL}, ' ') AS t FROM documents)",
}
