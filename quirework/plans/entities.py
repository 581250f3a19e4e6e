"""Queries over names and vectors: linking, candidate pairs, evidence, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import linking as L
from ..operators import resolve as E
from ..operators.components import components
from .tables import longs, md5, table


def parts(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")


def names(spark, d):
    """Distinct names as entities: the smallest key of each, its name, and one word of it as another form."""
    return parts(spark, d).groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", "p_name")


def forms(spark, d):
    n = names(spark, d)
    return n.select("id", F.col("p_name").alias("form")).unionByName(n.select("id", F.element_at(F.split("p_name", " "), -1).alias("form")))


def pair_source_substring(spark, d):
    return E.substring_pairs(forms(spark, d), "id", "form")


def translated(spark, d):
    return names(spark, d).select("id", F.lower(F.col("p_name")).alias("form")).unionByName(names(spark, d).select("id", F.concat(F.lit("the "), F.lower(F.col("p_name"))).alias("form")))


def pair_translation_containment(spark, d):
    return E.substring_pairs(translated(spark, d), "id", "form")


def pair_shared_key(spark, d):
    return E.shared_value_pairs(names(spark, d).select("id", F.element_at(F.split("p_name", " "), 1).alias("reading")), "id", "reading")


def pair_alias_overlap(spark, d):
    n = names(spark, d)
    return E.alias_pairs(n.select("id", F.element_at(F.split("p_name", " "), -1).alias("v")), n.select("id", F.element_at(F.split("p_name", " "), -1).alias("v")), "id", "v")


def fuzzy(spark, d):
    return E.fuzzy_pairs(names(spark, d), "id", "p_name", 0.75)


def pair_jaro_winkler(spark, d):
    return fuzzy(spark, d).select("a", "b")


def pair_best_score(spark, d):
    return fuzzy(spark, d).select("a", "b", F.round("jw", 6).alias("jw"))


def pair_cosine(spark, d):
    return E.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.30).select("a", "b", F.round("cosine", 4).alias("cosine"))


def found(spark, d):
    tagged = {"source_substring": pair_source_substring(spark, d), "shared_reading": pair_shared_key(spark, d), "alias_overlap": pair_alias_overlap(spark, d), "jaro_winkler": fuzzy(spark, d)}
    categories = names(spark, d).select("id", (F.col("id") % 2).alias("category"))
    return E.evidence(tagged, categories)


def evidence_union(spark, d):
    return found(spark, d).select("a", "b", F.array_join("heuristics", ",").alias("heuristics"), F.round("jw", 6).alias("jw"), "same_category")


def confidence_tier(spark, d):
    return found(spark, d).select("a", "b", E.tier().alias("tier"))


def tier_with_vectors(spark, d):
    v = found(spark, d).withColumn("cosine", ((F.col("a") + F.col("b")) % 10) / 10)
    columns = ["a", "b", "heuristics", "same_category", "jw", "cosine"]
    vector = pair_cosine(spark, d).select(F.col("a"), F.col("b"), F.array(F.lit("embedding")).alias("heuristics"), F.lit(True).alias("same_category"), F.lit(None).cast("double").alias("jw"), "cosine")
    return v.select(*columns).unionByName(vector).select("a", "b", F.array_contains("heuristics", "embedding").alias("alone"), E.tier(embeddings=True).alias("tier"))


def directed(spark, d):
    n = names(spark, d)
    pairs = pair_source_substring(spark, d)
    return pairs.join(n.select(F.col("id").alias("a"), F.col("p_name").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("p_name").alias("nb")), "b")


def containment_direction(spark, d):
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return directed(spark, d).select("a", "b", E.direction(F.col("nb").contains(last("na")) & (F.col("na") != F.col("nb")), F.col("na").contains(last("nb")) & F.col("nb").startswith("b")).alias("container"))


def pick_winner(spark, d):
    none = F.lit(None).cast("string")
    return directed(spark, d).select("a", "b", E.winner(none, F.when((F.col("a") + F.col("b")) % 7 == 0, "b"), F.col("na"), F.col("nb"), F.col("a") % 5, F.col("b") % 5).alias("winner"))


def linked(spark, d):
    """Names linked where brand and type of their part are the same: edges to the smallest of each group."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type").withColumnRenamed("p_partkey", "id")
    return E.shared_value_edges(names(spark, d).join(p, "id").select("id", F.concat_ws("/", "p_brand", "p_type").alias("v")), "id", "v")


def merge_components(spark, d):
    return components(linked(spark, d))


def id_remap(spark, d):
    return E.remapped(pair_source_substring(spark, d), components(linked(spark, d)))


def merge_records(spark, d):
    n = names(spark, d)
    words = F.split("p_name", " ")
    entities = n.select("id", F.col("id").alias("ord"), F.col("p_name").alias("name"), F.array(F.col("p_name"), F.element_at(words, -1)).alias("forms"), F.array(F.element_at(words, 1)).alias("aliases"), F.element_at(words, 1).alias("notes"), F.col("id").alias("first_seen"), (F.col("id") * 2).alias("last_seen"))
    out = E.merged(entities, components(linked(spark, d)))
    return longs(out.select("id", "name", F.array_join("forms", "|").alias("forms"), F.array_join("aliases", "|").alias("aliases"), "notes", "first_seen", "last_seen", "n_merged"))


def mentions(spark, d):
    """Parts as mentions of four books, in the order of their keys."""
    p = parts(spark, d)
    return p.select(
        F.concat(F.lit("book"), F.col("p_partkey") % 4).alias("book_id"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("source"), F.when(F.col("p_partkey") % 9 == 0, F.element_at(F.split("p_name", " "), 1)).alias("reading"),
        F.upper("p_name").alias("translation"), F.lower("p_type").alias("category"), F.format_string("%04d.001", F.col("p_partkey")).alias("chunk_id"), F.concat(F.lit("of "), F.col("p_brand")).alias("summary"),
        F.concat(F.lit("sold as "), F.col("p_type")).alias("notes"), F.array(F.element_at(F.split("p_name", " "), -1)).alias("aliases"), F.array(F.struct(F.col("p_type").alias("speaker"), F.col("p_brand").alias("nick"))).alias("nicknames"), F.col("p_brand").alias("speech_style"), F.col("p_type").alias("context_hint"),
    )


def mention_link_exact(spark, d):
    return longs(L.exact_links(mentions(spark, d)))


def mention_link_fold(spark, d):
    return longs(L.fold_mentions(mentions(spark, d)))


def entity_fold(spark, d):
    return longs(L.fold_entities(mentions(spark, d)).withColumns({c: F.array_join(c, "|") for c in ("sources", "translations", "aliases", "nicknames", "hints")}))


def reconcile_apply(spark, d):
    """Forms after decisions that name the last of each form's variants."""
    forms = L.surface_forms(links(spark, d))
    decisions = forms.where((F.size("translation_variants") > 0) & (F.length("source") % 2 == 0)).select(F.lit("variants").alias("work"), "entity_id", F.col("source").alias("item"), F.element_at("translation_variants", -1).alias("value"))
    entities = forms.select("entity_id", F.col("entity_id").alias("name"), F.lit("").alias("speech_style")).distinct()
    out, _, _ = L.reconciled(forms, entities, decisions)
    return out.select("entity_id", "source", "translation", F.array_join("translation_variants", "|").alias("translation_variants"))


def correction_conflicts(spark, d):
    """Conflicts after corrections: every fourth part proposes another translation of its name's last word."""
    l = links(spark, d)  # noqa: E741
    entities = l.groupBy("entity_id").agg(F.min_by("category", "ord").alias("category")).select("entity_id", F.col("entity_id").alias("name"), "category")
    forms = l.select("entity_id", "source").distinct()
    corrections = parts(spark, d).where(F.col("p_partkey") % 4 == 0).select(F.col("p_partkey").alias("ord"), F.element_at(F.split("p_name", " "), -1).alias("existing_translation"), F.col("p_name").alias("source_term"), F.concat(F.col("p_type"), F.lit("!")).alias("corrected_translation"))
    out = L.conflicts(L.corrected(corrections, entities, forms, l))
    return out.select("entity_id", "current_translation", F.array_join("alternatives", "|").alias("alternatives"))


def summary_compress(spark, d):
    """Summaries of conversations' speakers: one observation alone is taken as it is, several are told by their number."""
    t = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    o = t.select(F.concat_ws("/", "conv_id", "role").alias("entity_id"), F.when(F.col("conv_id") % 7 == 0, "user").otherwise("extracted").alias("origin"), F.when(F.col("conv_id") % 5 == 0, "known").alias("summary"), F.format_string("%06d", "turn").alias("chunk_id"), "text")
    told = lambda todo: todo.select("entity_id", F.when(F.length("text") % 2 == 0, F.concat(F.lit("in short "), F.md5(F.col("text").cast("binary")))).otherwise(F.lit(" ")).alias("answer"))
    return L.compressed(o, told, 120)

def links(spark, d):
    """Parts linked to the entity of their name's last word."""
    p = parts(spark, d)
    return p.select(F.element_at(F.split("p_name", " "), -1).alias("entity_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("source"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("translation"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("reading"), F.format_string("%06d", F.col("p_partkey")).alias("chunk_id"), F.col("p_type").alias("category"))


def surface_form_upsert(spark, d):
    return longs(L.surface_forms(links(spark, d)).withColumn("translation_variants", F.array_join("translation_variants", "|")))


def conflict_log(spark, d):
    return L.conflicts(links(spark, d)).select("entity_id", "source_form", "current_translation", F.array_join("alternatives", "|").alias("alternatives"), F.array_join("category_variants", "|").alias("category_variants"))


def summary_fold(spark, d):
    turns = table(spark, d, "conversations", "conv_id", "turn", "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: F.replace(x["t"], F.lit("\n"), F.lit(" ")))
    return turns.groupBy("conv_id").agg(listed.alias("l")).select("conv_id", L.summary_fold(F.col("l"), 200).alias("summary"))


def entity_ids(spark, d):
    p = parts(spark, d).select("p_partkey", F.lower("p_type").alias("category"))
    old = p.where(F.col("p_partkey") < 20).select("category", F.concat(F.col("category"), F.format_string("_%06d", F.col("p_partkey"))).alias("entity_id"))
    return L.next_ids(old, p.where(F.col("p_partkey") >= 20), "category", "entity_id", "p_partkey").select("p_partkey", "entity_id")


def correction_targets(spark, d):
    n = names(spark, d)
    entities = n.select(F.concat(F.lit("e"), F.col("id")).alias("entity_id"), F.upper(F.element_at(F.split("p_name", " "), 1)).alias("name"))
    surface = n.select(F.concat(F.lit("e"), F.col("id")).alias("entity_id"), F.when(F.col("id") % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1)).alias("source"))
    corrections = n.select(F.col("id").alias("ord"), F.when(F.col("id") % 4 == 0, F.upper(F.element_at(F.split("p_name", " "), 1))).otherwise("").alias("existing_translation"), F.col("p_name").alias("source_term"))
    return L.correction_targets(corrections, entities, surface).select("ord", "entity_id")


def reconcile_work(spark, d):
    styles = names(spark, d).select(F.col("id").cast("string").alias("entity_id"), F.when(F.col("id") % 6 == 0, F.concat(F.col("p_name"), F.lit("\nshort"))).otherwise(F.col("p_name")).alias("speech_style"))
    return L.reconcile_work(L.surface_forms(links(spark, d)), L.conflicts(links(spark, d)), styles).select("work", "entity_id", F.coalesce("item", F.lit("")).alias("item"), "needs_call")


def glossary_export(spark, d):
    n = names(spark, d).join(parts(spark, d).select(F.col("p_partkey").alias("id"), "p_type", "p_brand"), "id")
    out = X.glossary_text(n, "p_type", "p_name", "p_brand", {"SMALL": 0, "ECONOMY": 1})
    return out.select(md5(F.col("markdown")).alias("md5"), F.length("markdown").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    pair_source_substring, pair_translation_containment, pair_shared_key, pair_alias_overlap, pair_jaro_winkler, pair_best_score, pair_cosine, evidence_union, confidence_tier, tier_with_vectors,
    containment_direction, pick_winner, merge_components, id_remap, merge_records, mention_link_exact, mention_link_fold, entity_fold, surface_form_upsert, conflict_log, summary_fold, entity_ids,
    correction_targets, reconcile_work, reconcile_apply, correction_conflicts, summary_compress, glossary_export,
)}

N = "n AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name)"
LAST = "list_last(string_split({}, ' '))".format
FIRST = "string_split({}, ' ')[1]".format
SUBSTRING = f"f AS (SELECT id, p_name AS form FROM n UNION SELECT id, {LAST('p_name')} FROM n), ss AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM f x JOIN f y ON x.id <> y.id AND length(x.form) > 1 AND contains(y.form, x.form))"
SHARED = f"k AS (SELECT id, {FIRST('p_name')} AS w FROM n), sk AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.w = y.w AND x.id < y.id)"
ALIAS = f"al AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM n x JOIN n y ON x.id <> y.id AND {LAST('x.p_name')} = {LAST('y.p_name')})"
FUZZY = "jw AS (SELECT a, b, s AS jw FROM (SELECT x.id AS a, y.id AS b, greatest(jaro_winkler_similarity(x.p_name, y.p_name), jaro_winkler_similarity(reverse(x.p_name), reverse(y.p_name))) AS s FROM n x JOIN n y ON x.id < y.id) WHERE s >= 0.75)"
FOUND = f"""{N}, {SUBSTRING}, {SHARED}, {ALIAS}, {FUZZY}, t AS (SELECT a, b, 'source_substring' AS h, NULL::DOUBLE AS jw FROM ss UNION ALL SELECT a, b, 'shared_reading', NULL FROM sk UNION ALL SELECT a, b, 'alias_overlap', NULL FROM al UNION ALL SELECT a, b, 'jaro_winkler', jw FROM jw),
ev AS (SELECT a, b, string_agg(DISTINCT h, ',' ORDER BY h) AS heuristics, max(jw) AS jw, a % 2 = b % 2 AS same_category, count(DISTINCT h) FILTER (h <> 'jaro_winkler') + CASE WHEN max(jw) >= 0.9 THEN 1 ELSE 0 END AS strong FROM t GROUP BY a, b)"""
LINKED = f"{N}, kv AS (SELECT id, concat_ws('/', p_brand, p_type) AS v FROM n JOIN part ON p_partkey = id), li AS (SELECT x.id AS a, y.id AS b FROM kv x JOIN kv y ON x.v = y.v AND x.id < y.id), bo AS (SELECT a, b FROM li UNION SELECT b, a FROM li), re AS (SELECT a AS node, b AS r FROM bo UNION SELECT re.node, bo.b FROM re JOIN bo ON bo.a = re.r), co AS (SELECT node, least(node, min(r)) AS component FROM re GROUP BY node)"
COS = "cs AS (SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS cosine, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE c >= 0.30)"
LINKS = f"l AS (SELECT {LAST('p_name')} AS entity_id, p_partkey AS ord, p_name AS source, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS translation, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS reading, printf('%06d', p_partkey) AS chunk_id, p_type AS category FROM part)"
DISTINCT = "list_transform(list_sort(list_transform(map_entries(m), lambda e: {'o': e.value, 'v': e.key})), lambda x: x.v)"


def firsts(keys: str, value: str, where: str = "true") -> str:
    """Distinct values in the order of their first place, by keys."""
    return f"(SELECT {keys}, list(v ORDER BY o) AS vs FROM (SELECT {keys}, {value} AS v, min(ord) AS o FROM l WHERE {where} GROUP BY {keys}, {value}) GROUP BY {keys})"


FORMS = f"sf AS (SELECT x.entity_id, x.source, x.occurrence_count, tr.vs[1] AS translation, coalesce(array_to_string(tr.vs[2:], '|'), '') AS translation_variants, len(tr.vs) AS nv, x.reading, x.first_seen_chunk FROM (SELECT entity_id, source, count(*) AS occurrence_count, arg_min(reading, ord) FILTER (length(reading) > 0) AS reading, arg_min(chunk_id, ord) AS first_seen_chunk FROM l GROUP BY ALL) x LEFT JOIN {firsts('entity_id, source', 'translation', 'length(translation) > 0')} tr ON tr.entity_id = x.entity_id AND tr.source = x.source)"
CONFLICTS = f"cf AS (SELECT x.entity_id, x.source_form, tr.vs[1] AS current_translation, coalesce(array_to_string(tr.vs[2:], '|'), '') AS alternatives, coalesce(array_to_string(k.vs[2:], '|'), '') AS category_variants, coalesce(len(tr.vs), 0) > 1 AS told FROM (SELECT entity_id, arg_min(source, ord) AS source_form FROM l GROUP BY 1) x LEFT JOIN {firsts('entity_id', 'translation', 'length(translation) > 0')} tr ON tr.entity_id = x.entity_id JOIN {firsts('entity_id', 'category')} k ON k.entity_id = x.entity_id WHERE len(tr.vs) > 1 OR len(k.vs) > 1)"

ORACLE = {
    "pair_source_substring": f"WITH {N}, {SUBSTRING} SELECT a, b FROM ss",
    "pair_translation_containment": f"WITH {N}, f AS (SELECT id, lower(p_name) AS form FROM n UNION SELECT id, 'the ' || lower(p_name) FROM n) SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM f x JOIN f y ON x.id <> y.id AND contains(y.form, x.form)",
    "pair_shared_key": f"WITH {N}, {SHARED} SELECT a, b FROM sk",
    "pair_alias_overlap": f"WITH {N}, {ALIAS} SELECT a, b FROM al",
    "pair_jaro_winkler": f"WITH {N}, {FUZZY} SELECT a, b FROM jw",
    "pair_best_score": f"WITH {N}, {FUZZY} SELECT a, b, round(jw, 6) AS jw FROM jw",
    "pair_cosine": f"WITH {COS} SELECT a, b, cosine FROM cs",
    "evidence_union": f"WITH {FOUND} SELECT a, b, heuristics, round(jw, 6) AS jw, same_category FROM ev",
    "confidence_tier": f"WITH {FOUND} SELECT a, b, CASE WHEN strong >= 2 AND same_category THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM ev",
    "tier_with_vectors": f"WITH {FOUND}, {COS}, al2 AS (SELECT a, b, strong, same_category, ((a + b) % 10) / 10 AS c, false AS alone FROM ev UNION ALL SELECT a, b, 0, true, cosine, true FROM cs) SELECT a, b, alone, CASE WHEN alone AND c < 0.5 THEN 'LOW' WHEN strong + CASE WHEN c >= 0.82 THEN 1 ELSE 0 END >= 2 AND c >= 0.82 AND same_category THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM al2",
    "containment_direction": f"WITH {N}, {SUBSTRING}, p AS (SELECT a, b, contains(y.p_name, {LAST('x.p_name')}) AND x.p_name <> y.p_name AS ab, contains(x.p_name, {LAST('y.p_name')}) AND y.p_name LIKE 'b%' AS ba FROM ss JOIN n x ON x.id = a JOIN n y ON y.id = b) SELECT a, b, CASE WHEN ab AND NOT ba THEN 'b' WHEN ba AND NOT ab THEN 'a' END AS container FROM p",
    "pick_winner": f"WITH {N}, {SUBSTRING} SELECT a, b, CASE WHEN (a + b) % 7 = 0 THEN 'b' WHEN length(x.p_name) > length(y.p_name) THEN 'a' WHEN length(y.p_name) > length(x.p_name) THEN 'b' WHEN a % 5 <= b % 5 THEN 'a' ELSE 'b' END AS winner FROM ss JOIN n x ON x.id = a JOIN n y ON y.id = b",
    "merge_components": f"WITH RECURSIVE {LINKED} SELECT node, component FROM co",
    "id_remap": f"WITH RECURSIVE {LINKED}, {SUBSTRING}, m AS (SELECT coalesce(x.component, a) AS p, coalesce(y.component, b) AS q FROM ss LEFT JOIN co x ON x.node = a LEFT JOIN co y ON y.node = b) SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM m WHERE p <> q",
    "merge_records": f"""WITH RECURSIVE {LINKED}, r AS (SELECT coalesce(c.component, n.id) AS root, n.id, n.p_name, row_number() OVER (PARTITION BY coalesce(c.component, n.id) ORDER BY n.id) AS rn FROM n LEFT JOIN co c ON c.node = n.id),
fo AS (SELECT root, string_agg(v, '|' ORDER BY o) AS forms FROM (SELECT root, v, min(o) AS o FROM (SELECT root, p_name AS v, 2 * rn AS o FROM r UNION ALL SELECT root, {LAST('p_name')}, 2 * rn + 1 FROM r) GROUP BY root, v) GROUP BY root),
li2 AS (SELECT root, v, min(rn) AS o FROM (SELECT root, {FIRST('p_name')} AS v, rn FROM r) GROUP BY root, v), st AS (SELECT root, string_agg(v, '|' ORDER BY o) AS aliases, list_reduce(list(v ORDER BY o), lambda s, w: CASE WHEN contains(s, w) THEN s ELSE s || ' ' || w END) AS notes FROM li2 GROUP BY root)
SELECT root AS id, arg_min(p_name, rn) AS name, any_value(forms) AS forms, any_value(aliases) AS aliases, any_value(notes) AS notes, min(id) AS first_seen, max(id * 2) AS last_seen, count(*) AS n_merged FROM r JOIN fo USING (root) JOIN st USING (root) GROUP BY root""",
    "mention_link_exact": "SELECT 'book' || p_partkey % 4 AS book_id, p_name AS source, min(p_partkey) AS first_ord, count(*) AS n FROM part GROUP BY ALL",
    "surface_form_upsert": f"WITH {LINKS}, {FORMS} SELECT entity_id, source, occurrence_count, translation, translation_variants, reading, first_seen_chunk FROM sf",
    "conflict_log": f"WITH {LINKS}, {CONFLICTS} SELECT entity_id, source_form, current_translation, alternatives, category_variants FROM cf",
    "summary_fold": r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, replace(text, chr(10), ' ') AS x FROM conversations),
s AS (SELECT conv_id, 0::BIGINT AS n, '' AS s FROM t GROUP BY conv_id UNION ALL SELECT conv_id, n, CASE WHEN contains(s, x) OR x = '' THEN s WHEN length(j) > 200 THEN regexp_replace(substr(j, 1, 200), ' [^ ]*$', '') || '...' ELSE j END FROM (SELECT s.conv_id, t.n, s.s, t.x, CASE WHEN s.s = '' THEN t.x ELSE s.s || ' ' || t.x END AS j FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1))
SELECT conv_id, arg_max(s, n) AS summary FROM s GROUP BY conv_id""",
    "entity_ids": "WITH p AS (SELECT p_partkey, lower(p_type) AS c FROM part), m AS (SELECT c, max(p_partkey) AS top FROM p WHERE p_partkey < 20 GROUP BY c) SELECT p_partkey, c || printf('_%06d', coalesce(top, 0) + row_number() OVER (PARTITION BY c ORDER BY p_partkey)) AS entity_id FROM p LEFT JOIN m USING (c) WHERE p_partkey >= 20",
    "correction_targets": f"WITH {N}, e AS (SELECT 'e' || id AS eid, upper({FIRST('p_name')}) AS name FROM n), bn AS (SELECT name, min(eid) AS eid FROM e GROUP BY name HAVING count(*) = 1), s AS (SELECT 'e' || id AS eid, CASE WHEN id % 2 = 0 THEN p_name ELSE {LAST('p_name')} END AS src FROM n), bs AS (SELECT src, min(eid) AS eid FROM s GROUP BY src HAVING count(DISTINCT eid) = 1) SELECT n.id AS ord, coalesce(bn.eid, bs.eid, 'unknown:' || p_name) AS entity_id FROM n LEFT JOIN bn ON bn.name = CASE WHEN id % 4 = 0 THEN upper({FIRST('p_name')}) ELSE '' END LEFT JOIN bs ON bs.src = p_name",
    "reconcile_work": f"WITH {LINKS}, {FORMS}, {CONFLICTS}, {N}, w AS (SELECT 'variants' AS work, entity_id, source AS item, true AS needs_call FROM sf WHERE nv > 1 UNION ALL SELECT 'conflict', entity_id, source_form, told FROM cf UNION ALL SELECT 'speech', id::VARCHAR, '', true FROM n WHERE id % 6 = 0) SELECT work, entity_id, item, needs_call FROM w",
    "reconcile_apply": f"WITH {LINKS}, {FORMS}, v AS (SELECT *, translation_variants <> '' AND length(source) % 2 = 0 AS done FROM sf) SELECT entity_id, source, CASE WHEN done THEN list_last(string_split(translation_variants, '|')) ELSE translation END AS translation, CASE WHEN done THEN '' ELSE translation_variants END AS translation_variants FROM v",
    "correction_conflicts": f"""WITH {LINKS}, tp AS (SELECT max(ord) AS top FROM l), fo AS (SELECT source, min(entity_id) AS e FROM l GROUP BY source HAVING count(DISTINCT entity_id) = 1), en AS (SELECT DISTINCT entity_id AS e FROM l),
co AS (SELECT p_partkey AS o, coalesce(en.e, fo.e, 'unknown:' || p_name) AS entity_id, {LAST('p_name')} AS was, p_type || '!' AS new FROM part LEFT JOIN en ON en.e = {LAST('p_name')} LEFT JOIN fo ON fo.source = p_name WHERE p_partkey % 4 = 0),
al AS (SELECT entity_id, ord, translation AS t FROM l UNION ALL SELECT entity_id, top + 2 * o + 1, was FROM co, tp UNION ALL SELECT entity_id, top + 2 * o + 2, new FROM co, tp),
fi AS (SELECT entity_id, list(t ORDER BY o) AS vs FROM (SELECT entity_id, t, min(ord) AS o FROM al WHERE length(t) > 0 GROUP BY entity_id, t) GROUP BY entity_id),
ca AS (SELECT entity_id, count(DISTINCT category) AS n FROM l GROUP BY entity_id)
SELECT entity_id, vs[1] AS current_translation, array_to_string(vs[2:], '|') AS alternatives FROM fi LEFT JOIN ca USING (entity_id) WHERE len(vs) > 1 OR n > 1""",
    "summary_compress": r"""WITH o AS (SELECT conv_id || '/' || role AS entity_id, turn, text FROM conversations WHERE conv_id % 7 <> 0 AND conv_id % 5 <> 0 AND length(text) > 0), b AS (SELECT entity_id, count(*) AS n, string_agg(text, ' ' ORDER BY printf('%06d', turn), text) AS t FROM o GROUP BY entity_id),
w AS (SELECT entity_id, CASE WHEN n > 1 AND length(t) % 2 = 0 THEN 'in short ' || md5(t) ELSE t END AS s FROM b) SELECT entity_id, CASE WHEN length(s) > 120 THEN regexp_replace(substr(s, 1, 120), ' [^ ]*$', '') || '...' ELSE s END AS summary FROM w""",
    "glossary_export": f"""WITH {N}, e AS (SELECT n.p_name, p_type, p_brand FROM n JOIN part ON p_partkey = n.id), c AS (SELECT p_type, '## ' || p_type || chr(10) || chr(10) || string_agg('- **' || p_name || '**: ' || p_brand, chr(10) ORDER BY lower(p_name), p_name) AS s, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS r FROM e GROUP BY p_type), m AS (SELECT string_agg(s, chr(10) || chr(10) ORDER BY r, p_type) AS t FROM c) SELECT md5(t) AS md5, length(t) AS n_chars FROM m""",
}
