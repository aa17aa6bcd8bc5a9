"""Queries of understanding, context assembly, generation and constraints.

Questions are the benchmark passages. Where the tables lack something, it is made here the same way on
both sides: years are 2000 + doc_id % 25, the year asked about is 2005 + query_id % 20, and answers get bad markers planted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators import abbreviations, constraints, context, entities, rerank, retrieve, understand
from evidora.plans.base import Tables, query
from evidora.plans.retrieval import LAST, REL, RUN, TOK, relevance

DICTIONARY = [("the", "der"), ("and", "und"), ("of", "von"), ("that", "dass"), ("with", "mit"), ("for", "für"), ("was", "war"), ("is", "ist"), ("are", "sind"), ("from", "aus"), ("this", "dies"), ("it", "es")]
SYNONYMS = [("the", "this"), ("the", "that"), ("of", "from"), ("and", "plus"), ("with", "by"), ("for", "pro"), ("are", "is")]
NAMES = ["of the", "in the", "the", "and", "that the", "for", "with the"]


def _values(rows: list, names: str) -> str:
    cell = lambda r: "(" + ", ".join(f"'{x}'" for x in (r if isinstance(r, tuple) else (r,))) + ")"
    return f"(VALUES {', '.join(map(cell, rows))}) v({names})"


DICT = f"dict AS (SELECT * FROM {_values(DICTIONARY, 'src, dst')})"
QTOK = f"qw AS (SELECT item_id, text, {TOK.format('text')} AS t FROM benchmark), qp AS (SELECT item_id, unnest(t) AS src, generate_subscripts(t, 1) AS pos FROM qw)"
TRANSLATED = f"{DICT}, {QTOK}, tr AS (SELECT item_id, string_agg(dst, ' ' ORDER BY pos) AS q FROM qp JOIN dict USING (src) GROUP BY item_id)"


def dictionary(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(DICTIONARY, "src string, dst string")


def synonyms(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(SYNONYMS, "term string, synonym string")


@query("qu_dict_translate", f"WITH {TRANSLATED} SELECT item_id, coalesce(q, '') AS retrieval_query FROM benchmark LEFT JOIN tr USING (item_id)")
def qu_dict_translate(t: Tables) -> DataFrame:
    return understand.translate(t.benchmark, dictionary(t)).select("item_id", "retrieval_query")


@query("qu_dropped_terms", f"WITH {DICT}, {QTOK} SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(t, lambda x: NOT list_contains(known, x)))), ' '), '') AS dropped FROM qw, (SELECT list(src) AS known FROM dict)")
def qu_dropped_terms(t: Tables) -> DataFrame:
    return understand.translate(t.benchmark, dictionary(t)).select("item_id", F.array_join("dropped", " ").alias("dropped"))


@query("qu_entities", f"WITH {QTOK}, g AS (SELECT w.item_id, p.pos - 1 AS pos, n, array_to_string(w.t[p.pos : p.pos + n - 1], ' ') AS name FROM qw w JOIN qp p USING (item_id), (VALUES (1), (2), (3)) v(n) WHERE p.pos + n - 1 <= len(w.t)) SELECT item_id, pos::BIGINT AS pos, arg_max(name, n) AS entity FROM g WHERE name IN ({', '.join(repr(x) for x in NAMES)}) GROUP BY item_id, pos")
def qu_entities(t: Tables) -> DataFrame:
    return understand.entities(t.benchmark, t.spark.createDataFrame([(x,) for x in NAMES], "name string"))


#: Names: the first two and three tokens of every document.
PHRASES = r"nt AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), names AS (SELECT DISTINCT array_to_string(t[1 : n], ' ') AS name, n FROM nt, range(2, 4) b(n) WHERE n <= len(t))"


def phrases(t: Tables) -> DataFrame:
    toks = t.documents.select(F.slice(tokens(F.col("text")), 1, 3).alias("t"))
    return toks.select(F.explode(F.array(*[F.when(F.size("t") >= n, F.array_join(F.slice("t", 1, n), " ")) for n in (2, 3)])).alias("name"))


@query("qu_entities_automaton", "WITH RECURSIVE " + PHRASES + r", ct AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM conversations), g AS (SELECT conv_id, turn, p - 1 AS pos, n, array_to_string(t[p : p + n - 1], ' ') AS name FROM ct, range(2, 4) b(n), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS p) WHERE p + n - 1 <= len(t)), m AS (SELECT conv_id, turn, pos, max(g.n) AS n, max_by(name, g.n) AS entity FROM g JOIN names USING (name, n) GROUP BY ALL), nx AS (SELECT a.*, (SELECT min(b.pos) FROM m b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.pos >= a.pos + a.n) AS next FROM m a), r AS (SELECT nx.* FROM nx JOIN (SELECT conv_id, turn, min(pos) AS pos FROM nx GROUP BY ALL) USING (conv_id, turn, pos) UNION ALL SELECT nx.* FROM r JOIN nx ON nx.conv_id = r.conv_id AND nx.turn = r.turn AND nx.pos = r.next) SELECT conv_id, turn, pos, entity FROM r")
def qu_entities_automaton(t: Tables) -> DataFrame:
    """Names from a table in every conversation's turns, leftmost-longest."""
    return entities.recognised(t.conversations, phrases(t), ("conv_id", "turn"))


@query("qu_synonyms", f"WITH {QTOK}, s AS (SELECT * FROM {_values(SYNONYMS, 'term, synonym')}) SELECT DISTINCT item_id, src AS term FROM qp UNION SELECT item_id, synonym FROM qp JOIN s ON s.term = src")
def qu_synonyms(t: Tables) -> DataFrame:
    return understand.expand(t.benchmark, synonyms(t))


@query("qu_filters", r"SELECT page_id, regexp_extract(url, '((?:19|20)\d\d)', 1) AS year, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages")
def qu_filters(t: Tables) -> DataFrame:
    return understand.filters(t.pages, "page_id", "url")


@query("qu_tag", r"SELECT item_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'T3' WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'T1' ELSE 'T2' END AS class FROM benchmark")
def qu_tag(t: Tables) -> DataFrame:
    return understand.tag(t.benchmark)


@query("qu_translate_cache", f"WITH {TRANSLATED} SELECT item_id, CASE WHEN contains(text, chr(10)) THEN coalesce(q, '') ELSE 'cached ' || item_id END AS translation, NOT contains(text, chr(10)) AS hit FROM benchmark LEFT JOIN tr USING (item_id)")
def qu_translate_cache(t: Tables) -> DataFrame:
    """The frozen cache stands for passages of one line."""
    cache = t.benchmark.where(~F.contains("text", F.lit("\n"))).select("text", F.concat(F.lit("cached "), F.col("item_id")).alias("translation"))
    return understand.cached_translation(t.benchmark, cache, understand.translate(t.benchmark, dictionary(t)))


@query("qu_translate_model", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS retrieval_query FROM benchmark")
def qu_translate_model(t: Tables) -> DataFrame:
    """The translator protocol with its stand-in."""
    return understand.translated(t.benchmark, understand.Unchanged())


@query("dict_stats", "WITH s AS (SELECT DISTINCT lower(name) AS term, lower(brand) AS synonym FROM items WHERE name IS NOT NULL AND brand IS NOT NULL) SELECT count(*) AS n_pairs, count(DISTINCT term) AS n_terms, round(count(*) / count(DISTINCT term), 6) AS per_term FROM s")
def dict_stats(t: Tables) -> DataFrame:
    """Size of a dictionary that a table holds: names of items and the brands that go by them."""
    pairs = t.items.where("name is not null and brand is not null").select(F.lower("name").alias("term"), F.lower("brand").alias("synonym")).distinct()
    per = pairs.groupBy("term").agg(F.count("*").alias("n"))  # distinct terms need no second count
    return per.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_terms"), F.round(F.sum("n") / F.count("*"), 6).alias("per_term"))


# ---- context -----------------------------------------------------------------------------

CAND = REL + LAST + r", cand AS (SELECT r.*, d.text, d.source, len(list_filter(string_split_regex(d.text, '\s+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM run2 r JOIN documents d USING (doc_id))"
UNIQ = CAND + ", uniq AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) = 1)"
DIV = UNIQ + ", dv AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2)"
BUD = DIV + ", bd AS (SELECT * FROM (SELECT *, (sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used FROM dv) WHERE used <= 2000)"
CTX = BUD + ", ctx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS s_no FROM bd)"
RENDER = CTX + ", rd AS (SELECT query_id, count(*) AS n_sources, string_agg('[S' || s_no || '] ' || text, chr(10) ORDER BY s_no) AS context FROM ctx GROUP BY query_id)"
EXTRACT = RENDER + r", ex AS (SELECT query_id, count(*) AS n_sources, string_agg(regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1) || ' [S' || s_no || ']', ' ' ORDER BY s_no) AS answer FROM ctx GROUP BY query_id)"
#: Planted faults: a marker 0 or 99, a lone number, and a last source left out.
ANSWERS = EXTRACT + ", ans AS (SELECT query_id, n_sources, CASE query_id % 3 WHEN 0 THEN answer || ' [S0]' WHEN 1 THEN replace(answer, ' [S' || n_sources || ']', '') || ' 4711 [S99]' ELSE answer END AS answer FROM ex)"


def run(t: Tables) -> DataFrame:
    return rerank.lexicographic(relevance(t)).select("query_id", "doc_id", "rel", "year", "rank")


def ctx(t: Tables) -> DataFrame:
    return context.assemble(run(t), t.documents)


def planted() -> Column:
    """An answer with its faults."""
    without = F.replace(F.col("answer"), F.concat(F.lit(" [S"), F.col("n_sources"), F.lit("]")), F.lit(""))
    return F.when(F.col("query_id") % 3 == 0, F.concat("answer", F.lit(" [S0]"))).when(F.col("query_id") % 3 == 1, F.concat(without, F.lit(" 4711 [S99]"))).otherwise(F.col("answer"))


def answers(t: Tables) -> DataFrame:
    return constraints.extractive(ctx(t)).select("query_id", "n_sources", planted().alias("answer"))


def references(t: Tables) -> DataFrame:
    """The documents of each context, and one that doesn't exist."""
    return ctx(t).select("query_id", F.explode(F.array("doc_id", 10**9 + F.col("query_id"))).alias("doc_id")).distinct()


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def dedup_exact(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("dedup_jaccard", f"WITH {CAND}, s AS (SELECT query_id, doc_id, list_distinct({TOK.format('text')}) AS t FROM cand), p AS (SELECT x.query_id, x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) AS n, len(y.t) AS m FROM s x JOIN s y ON x.query_id = y.query_id AND x.doc_id < y.doc_id) SELECT query_id, a, b, round(i / (n + m - i), 6) AS jaccard FROM p WHERE round(i / (n + m - i), 6) >= 0.5")
def dedup_jaccard(t: Tables) -> DataFrame:
    return context.similar_candidates(context.candidates(run(t), t.documents))


#: All pairs that share a shingle, and the closure of their links.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, {TOK.format("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
c AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS s FROM i),
t AS (SELECT doc_id, count(*) AS t FROM c GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM w),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE 5 * o >= 4 * (tx.t + ty.t - o) UNION SELECT class_id, doc_id FROM k WHERE class_id < doc_id),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d),
q AS (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY d)
SELECT doc_id, class_id, component_id FROM k JOIN q USING (doc_id)
"""


@query("dedup_minhash", NEAR)
def dedup_minhash(t: Tables) -> DataFrame:
    return context.dedup_minhash(t.documents)


@query("ctx_diversity", f"WITH {DIV} SELECT query_id, doc_id, source, rank FROM dv")
def ctx_diversity(t: Tables) -> DataFrame:
    return context.diverse(context.dedup_exact(context.candidates(run(t), t.documents))).select("query_id", "doc_id", "source", "rank")


@query("ctx_budget", f"WITH {BUD} SELECT query_id, doc_id, n_tokens, used FROM bd")
def ctx_budget(t: Tables) -> DataFrame:
    return context.within_budget(context.diverse(context.dedup_exact(context.candidates(run(t), t.documents)))).select("query_id", "doc_id", "n_tokens", "used")


@query("ctx_cite_numbers", f"WITH {CTX} SELECT query_id, doc_id, s_no, '[S' || s_no || ']' AS cite FROM ctx")
def ctx_cite_numbers(t: Tables) -> DataFrame:
    return ctx(t).select("query_id", "doc_id", "s_no", "cite")


@query("ctx_render", f"WITH {RENDER} SELECT query_id, n_sources, context FROM rd")
def ctx_render(t: Tables) -> DataFrame:
    return context.render(ctx(t))


@query("ctx_prompt", f"WITH {RENDER} SELECT item_id AS query_id, 'Answer from the sources below and cite them as [S#]; say so if they don''t tell.' || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(context, 'none') || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark LEFT JOIN rd ON query_id = item_id")
def ctx_prompt(t: Tables) -> DataFrame:
    return context.prompts(context.render(ctx(t)), t.benchmark)


# ---- generation and constraints ----------------------------------------------------------


#: Words as Python's split() parts them.
FIRST = r"array_to_string(list_filter(regexp_split_to_array(context, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')[1:40], ' ')"


@query("gen_stub_chain", f"WITH {RENDER} SELECT query_id, unnest(['assess', 'answer', 'critique', 'final']) AS stage, {FIRST} AS output FROM rd")
def gen_stub_chain(t: Tables) -> DataFrame:
    asked = context.render(ctx(t)).join(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return constraints.chain(asked, constraints.FirstWords())


@query("gen_extractive", f"WITH {EXTRACT} SELECT query_id, n_sources, answer FROM ex")
def gen_extractive(t: Tables) -> DataFrame:
    return constraints.extractive(ctx(t))


@query("ablation_ratio", f"WITH {EXTRACT}, w AS (SELECT query_id, 4 * length({FIRST}) AS staged FROM rd) SELECT count(*) AS n, round(sum(staged) / sum(length(answer)), 6) AS ratio, max(staged)::BIGINT AS most FROM ex JOIN w USING (query_id)")
def ablation_ratio(t: Tables) -> DataFrame:
    """What the four stages of the chain write against the direct answer, in characters; both by stand-ins."""
    staged = gen_stub_chain(t).groupBy("query_id").agg(F.sum(F.length("output")).alias("staged"))
    both = constraints.extractive(ctx(t)).join(staged, "query_id")
    return both.agg(F.count("*").alias("n"), F.round(F.sum("staged") / F.sum(F.length("answer")), 6).alias("ratio"), F.max("staged").alias("most"))


CITED = r"list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda x: x::BIGINT)"


@query("chk_cite_range", f"WITH {ANSWERS} SELECT query_id, n_sources, len({CITED})::BIGINT AS n_cited, len(list_filter({CITED}, lambda x: x < 1 OR x > n_sources))::BIGINT AS n_bad FROM ans")
def chk_cite_range(t: Tables) -> DataFrame:
    return constraints.out_of_range(answers(t))


@query("chk_fabricated", f"WITH {CTX}, refs AS (SELECT query_id, doc_id FROM ctx UNION ALL SELECT DISTINCT query_id, 1000000000 + query_id FROM ctx) SELECT query_id, doc_id FROM refs WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def chk_fabricated(t: Tables) -> DataFrame:
    return constraints.fabricated(references(t), t.documents)


@query("refuse_boundary", f"WITH {RUN}, b AS (SELECT query_id, max(score) AS best FROM run WHERE rank <= 10 GROUP BY query_id) SELECT item_id AS query_id, best, coalesce(best, 0) < 60 AS refused FROM benchmark LEFT JOIN b ON query_id = item_id")
def refuse_boundary(t: Tables) -> DataFrame:
    return constraints.beyond_boundary(t.benchmark, retrieve.bm25(t.documents, t.benchmark), 60.0)


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), (2005 + F.col("item_id") % 20).alias("asked_year"))


@query("refuse_temporal", f"WITH {CTX} SELECT query_id, doc_id, year, (2005 + query_id % 20)::BIGINT AS asked_year FROM ctx WHERE year > 2005 + query_id % 20")
def refuse_temporal(t: Tables) -> DataFrame:
    return constraints.too_late(ctx(t).select("query_id", "doc_id", "year"), asked(t))


TRI = CTX + ", tri AS (SELECT item_id AS query_id, count(doc_id) AS n, count(doc_id) FILTER (WHERE year > 2005 + item_id % 20) AS n_late FROM benchmark LEFT JOIN ctx ON query_id = item_id GROUP BY item_id), status AS (SELECT *, CASE WHEN n = n_late THEN 'refused' WHEN n_late > 0 THEN 'partial' ELSE 'normal' END AS status FROM tri)"


@query("refuse_tristate", f"WITH {TRI} SELECT * FROM status")
def refuse_tristate(t: Tables) -> DataFrame:
    return constraints.tristate(ctx(t).select("query_id", "doc_id", "year"), asked(t))


@query("chk_sections", f"WITH {ANSWERS}, s AS (SELECT query_id, '## Answer' || chr(10) || answer || CASE WHEN query_id % 2 = 0 THEN chr(10) || '## References' ELSE '' END AS answer FROM ans) SELECT query_id, CASE WHEN contains(answer, '## References') THEN '' ELSE '## References' END AS missing, contains(answer, '## References') AS complete FROM s")
def chk_sections(t: Tables) -> DataFrame:
    a = answers(t).withColumn("answer", F.concat(F.lit("## Answer\n"), "answer", F.when(F.col("query_id") % 2 == 0, "\n## References").otherwise("")))
    return constraints.missing_sections(a, ["## Answer", "## References"])


@query("chk_abbrev", r"WITH w AS (SELECT doc_id, text, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: regexp_matches(x, '^[A-Z]{2,5}$')))) AS abbr FROM documents), p AS (SELECT doc_id, abbr, regexp_extract(text, '(?s)^(|.*?[^\p{L}\p{N}])' || abbr || '([^\p{L}\p{N}]|$)', 1) AS before FROM w) SELECT doc_id, abbr, length(before)::BIGINT + 1 AS first_pos, false AS introduced FROM p WHERE NOT ends_with(before, '(') UNION ALL SELECT doc_id, abbr, length(before)::BIGINT + 1, true FROM p WHERE ends_with(before, '(')")
def chk_abbrev(t: Tables) -> DataFrame:
    """No document of the tables has an abbreviation in brackets; abbr_definitions and tests have."""
    return abbreviations.introduced(t.documents)


@query("abbr_definitions", r"WITH n AS (SELECT client_id, name, string_split(name, ' ') AS w FROM clients WHERE regexp_matches(name, '^[^ .]+ [^ .]+$')), s AS (SELECT client_id, name, w[2] AS last, substr(w[1], 1, 1) || substr(w[2], 1, 1) AS short FROM n) SELECT client_id, length(name)::BIGINT + 4 AS pos, short, CASE WHEN regexp_matches(lower(last), '^' || lower(substr(short, 1, 1)) || '.*' || lower(substr(short, 2, 1))) THEN last ELSE name END AS long FROM s")
def abbr_definitions(t: Tables) -> DataFrame:
    """Sentences made of each client's name and its initials in brackets; the full form is the shortest that the letters fit."""
    name = F.col("name")
    short = F.concat(F.substring(name, 1, 1), F.substring(F.split(name, " ")[1], 1, 1))
    text = F.when(name.rlike("^[^ .]+ [^ .]+$"), F.concat(F.lit("Of "), name, F.lit(" ("), short, F.lit(") from "), F.coalesce("city", F.lit("nowhere"))))
    return abbreviations.defined(t.clients.select("client_id", text.alias("text")), "client_id").withColumnRenamed("id", "client_id")


@query("chk_refs_complete", f"WITH {ANSWERS}, c AS (SELECT query_id, list_distinct({CITED}) AS c, range(1, n_sources + 1) AS l FROM ans) SELECT query_id, coalesce(array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(l, x))), ','), '') AS unlisted, coalesce(array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(c, x))), ','), '') AS uncited FROM c")
def chk_refs_complete(t: Tables) -> DataFrame:
    return constraints.reference_balance(answers(t))


@query("fix_cites", f"WITH {EXTRACT} SELECT query_id, CASE query_id % 3 WHEN 1 THEN replace(answer, ' [S' || n_sources || ']', '') || ' 4711 [S' || n_sources || ']' ELSE answer END AS answer FROM ex")
def fix_cites(t: Tables) -> DataFrame:
    return constraints.repair(answers(t))


@query("chk_numbers", f"WITH {ANSWERS}, n AS (SELECT query_id, list_distinct(regexp_extract_all(regexp_replace(answer, '\\[S\\d+\\]', '', 'g'), '(\\d+(?:\\.\\d+)?)', 1)) AS a, regexp_extract_all(regexp_replace(context, '\\[S\\d+\\]', '', 'g'), '(\\d+(?:\\.\\d+)?)', 1) AS e FROM ans JOIN rd USING (query_id)), u AS (SELECT query_id, list_sort(list_filter(a, lambda x: NOT list_contains(e, x))) AS u FROM n) SELECT query_id, coalesce(array_to_string(u, ','), '') AS unsupported, len(u)::BIGINT AS n_unsupported FROM u")
def chk_numbers(t: Tables) -> DataFrame:
    c = ctx(t)
    return constraints.unsupported_numbers(answers(t), context.render(c))
