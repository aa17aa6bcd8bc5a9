"""Queries of evaluation and of service analytics.

Truth: documents that hold a benchmark passage verbatim. Tier: T1..T3 by item_id % 3 (synthetic)."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators import constraints, evaluate, retrieve, service, sketches, versions
from evidora.operators.links import cut
from evidora.plans.answers import ANSWERS, CTX, EXTRACT, ctx, planted, references
from evidora.plans.base import Tables, query
from evidora.plans.retrieval import BM25, RUN, TOK
from evidora.sources import requests
from evidora.sources.files import remove_folder, shared_folder

QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
BEST = f"{RUN}, {QRELS}, bst AS (SELECT query_id, count(*) AS n_targets, min(rank) AS best FROM qrels LEFT JOIN run USING (query_id, doc_id) GROUP BY query_id), best AS (SELECT item_id AS query_id, 'T' || (item_id % 3 + 1) AS tier, coalesce(n_targets, 0) AS n_targets, best FROM benchmark LEFT JOIN bst ON query_id = item_id)"
#: A second arm: BM25 with k1 = 1.2, over the same statistics.
ARM = BM25.replace("NAME", "arm").replace("K1", "1.2")
ARM = ARM[ARM.index("arms AS") :]
BEST2 = f"{BEST}, {ARM}, bst2 AS (SELECT query_id, min(rank) AS best FROM qrels LEFT JOIN arm USING (query_id, doc_id) GROUP BY query_id), best2 AS (SELECT item_id AS query_id, 'T' || (item_id % 3 + 1) AS tier, best FROM benchmark LEFT JOIN bst2 ON query_id = item_id)"


def qrels(t: Tables) -> DataFrame:
    return evaluate.passages(t.documents, t.benchmark)


def best(t: Tables, k1: float = 1.5) -> DataFrame:
    return evaluate.best_ranks(t.benchmark, qrels(t), retrieve.bm25(t.documents, t.benchmark, None, k1))


@query("eval_recall", f"WITH {BEST} SELECT tier, count(*) AS n, round(avg((coalesce(best, 1e9) <= 5)::INT), 6) AS r5, round(avg((coalesce(best, 1e9) <= 10)::INT), 6) AS r10, round(avg((coalesce(best, 1e9) <= 20)::INT), 6) AS r20 FROM best WHERE n_targets > 0 GROUP BY tier")
def eval_recall(t: Tables) -> DataFrame:
    return evaluate.recall(best(t))


@query("eval_mrr", f"WITH {BEST} SELECT tier, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM best WHERE n_targets > 0 GROUP BY tier")
def eval_mrr(t: Tables) -> DataFrame:
    return evaluate.mrr(best(t))


@query("eval_by_tier", f"WITH {BEST} SELECT tier, count(*) AS n_queries, count(*) FILTER (WHERE n_targets = 0) AS n_without_target, round(avg((coalesce(best, 1e9) <= 10)::INT) FILTER (WHERE n_targets > 0), 6) AS r10, round(avg(coalesce(1.0::DOUBLE / best, 0)) FILTER (WHERE n_targets > 0), 6) AS mrr FROM best GROUP BY tier")
def eval_by_tier(t: Tables) -> DataFrame:
    return evaluate.by_tier(best(t))


@query("eval_rank_hist", f"WITH {BEST} SELECT tier, CASE WHEN best IS NULL THEN 'missed' WHEN best <= 1 THEN '1' WHEN best <= 5 THEN '2-5' WHEN best <= 10 THEN '6-10' WHEN best <= 20 THEN '11-20' ELSE 'over 20' END AS bin, count(*) AS n FROM best WHERE n_targets > 0 GROUP BY ALL")
def eval_rank_hist(t: Tables) -> DataFrame:
    return evaluate.rank_histogram(best(t))


@query("eval_counterfactual", f"WITH {BEST2} SELECT query_id, best.best AS best_a, best2.best AS best_b, best.best IS NOT DISTINCT FROM best2.best AS same FROM best FULL JOIN best2 USING (query_id)")
def eval_counterfactual(t: Tables) -> DataFrame:
    return evaluate.compare(best(t), best(t, 1.2))


@query("eval_regression", f"WITH {RUN}, {ARM}, a AS (SELECT query_id, doc_id, rank, score FROM run WHERE rank <= 10), b AS (SELECT query_id, doc_id, rank, score FROM arm WHERE rank <= 10) (SELECT *, 'new' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'lost' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def eval_regression(t: Tables) -> DataFrame:
    return evaluate.regression(retrieve.bm25(t.documents, t.benchmark), retrieve.bm25(t.documents, t.benchmark, 10, 1.2))


@query("eval_dropouts", f"WITH {BEST2} SELECT count(*) AS n_in, count(*) FILTER (WHERE best2.best IS NULL OR best2.best > 10) AS n_dropped FROM best JOIN best2 USING (query_id) WHERE best.best <= 10")
def eval_dropouts(t: Tables) -> DataFrame:
    return evaluate.dropouts(best(t), best(t, 1.2))


@query("eval_delta", f"WITH {BEST2} SELECT best.tier, round(avg(coalesce(1.0::DOUBLE / best2.best, 0)) - avg(coalesce(1.0::DOUBLE / best.best, 0)), 6) AS delta_mrr, count(*) FILTER (WHERE best.best IS DISTINCT FROM best2.best) AS n_changed FROM best JOIN best2 USING (query_id) WHERE n_targets > 0 GROUP BY best.tier")
def eval_delta(t: Tables) -> DataFrame:
    a, b = best(t).where("n_targets > 0"), best(t, 1.2).select("query_id", F.col("best").alias("best_b"))
    r = lambda c: F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0)))
    return a.join(b, "query_id").groupBy("tier").agg(F.round(r("best_b") - r("best"), 6).alias("delta_mrr"), F.count(F.when(~F.col("best").eqNullSafe(F.col("best_b")), 1)).alias("n_changed"))


@query("eval_probe", f"WITH {CTX}, {QRELS} SELECT item_id AS query_id, item_id IN (SELECT query_id FROM qrels JOIN ctx USING (query_id, doc_id)) AS in_context FROM benchmark WHERE item_id IN (SELECT query_id FROM qrels)")
def eval_probe(t: Tables) -> DataFrame:
    """Whether a query's expected document reached the context."""
    q = qrels(t)
    found = q.join(ctx(t).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", F.lit(True).alias("f")).distinct()
    return q.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("f", F.lit(False)).alias("in_context"))


@query("eval_traceable", f"WITH {CTX}, refs AS (SELECT query_id, doc_id FROM ctx UNION ALL SELECT DISTINCT query_id, 1000000000 + query_id FROM ctx) SELECT count(*) AS n_refs, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_traceable, round(avg((doc_id IN (SELECT doc_id FROM documents))::INT), 6) AS rate FROM refs")
def eval_traceable(t: Tables) -> DataFrame:
    return evaluate_traceable(references(t), t.documents)


def evaluate_traceable(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    known = refs.join(catalog.select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return known.agg(F.count("*").alias("n_refs"), F.count("known").alias("n_traceable"), F.round(F.avg(F.coalesce("known", F.lit(0))), 6).alias("rate"))


KEYINFO = EXTRACT + f", ki AS (SELECT query_id, list_distinct({TOK.format('answer')}) AS a, list_distinct({TOK.format('text')}) AS g FROM ex JOIN benchmark ON item_id = query_id)"


def answered(t: Tables) -> DataFrame:
    return constraints.extractive(ctx(t)).join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("reference")), "query_id")


@query("eval_keyinfo", f"WITH {KEYINFO} SELECT count(*) AS n, round(avg(len(list_intersect(a, g)) / len(g)), 6) AS recall FROM ki")
def eval_keyinfo(t: Tables) -> DataFrame:
    g = F.array_distinct(tokens(F.col("reference")))
    return answered(t).agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.array_intersect(tokens(F.col("answer")), g)) / F.size(g)), 6).alias("recall"))


@query("eval_rouge1", f"WITH {EXTRACT}, pr AS (SELECT query_id, answer, text FROM ex JOIN benchmark ON item_id = query_id), a AS (SELECT query_id, t, count(*) AS na FROM (SELECT query_id, unnest({TOK.format('answer')}) AS t FROM pr) GROUP BY ALL), r AS (SELECT query_id, t, count(*) AS nr FROM (SELECT query_id, unnest({TOK.format('text')}) AS t FROM pr) GROUP BY ALL), s AS (SELECT query_id, sum(least(coalesce(na, 0), coalesce(nr, 0))) AS o, sum(na) AS a, sum(nr) AS r FROM a FULL JOIN r USING (query_id, t) GROUP BY query_id) SELECT query_id, round(o / a, 6) AS precision, round(o / r, 6) AS recall, round(CASE WHEN o > 0 THEN 2 * (o / a) * (o / r) / (o / a + o / r) ELSE 0 END, 6) AS f1 FROM s")
def eval_rouge1(t: Tables) -> DataFrame:
    return evaluate.rouge1(answered(t))


@query("eval_rougeL")
def eval_rouge_l(t: Tables) -> DataFrame:
    return evaluate.rouge_l(answered(t))


FLAGS = ANSWERS + r", fl AS (SELECT query_id, 'planted' AS arm, list_has_any(regexp_extract_all(answer, '\[S(\d+)\]', 1), ['0', '99']) AS bad, contains(answer, '4711') AS lone FROM ans UNION ALL SELECT query_id, 'plain', false, contains(answer, '4711') FROM ex)"


def flags(t: Tables) -> DataFrame:
    arms = F.array(F.struct(F.lit("plain").alias("arm"), "answer"), F.struct(F.lit("planted").alias("arm"), planted().alias("answer")))
    both = constraints.extractive(ctx(t)).select("query_id", "n_sources", F.explode(arms).alias("a")).select("query_id", "n_sources", "a.arm", "a.answer")
    bad = F.exists(constraints.cited(F.col("answer")), lambda x: (x < 1) | (x > F.col("n_sources")))
    return both.select("query_id", "arm", bad.alias("bad"), F.contains("answer", F.lit("4711")).alias("lone"))


@query("eval_rates", f"WITH {FLAGS} SELECT arm, count(*) AS n, round(avg(bad::INT), 6) AS bad_rate, round(avg(lone::INT) FILTER (WHERE bad), 6) AS lone_if_bad, round(avg((NOT bad)::INT), 6) AS compliance FROM fl GROUP BY arm")
def eval_rates(t: Tables) -> DataFrame:
    return flags(t).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("bad").cast("int")), 6).alias("bad_rate"), F.round(F.avg(F.when(F.col("bad"), F.col("lone").cast("int"))), 6).alias("lone_if_bad"), F.round(F.avg((~F.col("bad")).cast("int")), 6).alias("compliance"))


@query("eval_crosstab", f"WITH {FLAGS} SELECT arm, bad, lone, count(*) AS n FROM fl GROUP BY ALL")
def eval_crosstab(t: Tables) -> DataFrame:
    return flags(t).groupBy("arm", "bad", "lone").agg(F.count("*").alias("n"))


RUNS = "runs AS (SELECT user_id % 10 AS suite, user_id AS run_id, count(*) FILTER (WHERE event_type = 'signup') AS n_live, count(*) FILTER (WHERE event_type <> 'error') AS n_pass FROM events GROUP BY user_id)"


@query("guard_best_run", f"WITH {RUNS}, r AS (SELECT *, n_live > 0 AS live FROM runs) SELECT suite, run_id, live, n_pass FROM r QUALIFY row_number() OVER (PARTITION BY suite ORDER BY live DESC, n_pass DESC, run_id DESC) = 1")
def guard_best_run(t: Tables) -> DataFrame:
    """Users stand for suite runs: signups for live items, events but errors for passes."""
    runs = t.events.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "signup", 1)).alias("n_live"), F.count(F.when(F.col("event_type") != "error", 1)).alias("n_pass"))
    return evaluate.best_run(runs.select((F.col("user_id") % 10).alias("suite"), F.col("user_id").alias("run_id"), "n_live", "n_pass"))


@query("report_diff", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT line FROM l JOIN documents USING (doc_id) WHERE lang = 'en' AND NOT regexp_matches(line, '^generated at')), b AS (SELECT line FROM l JOIN documents USING (doc_id) WHERE lang <> 'en' AND NOT regexp_matches(line, '^generated at')) (SELECT line, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT line, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def report_diff(t: Tables) -> DataFrame:
    """Two reports stand for the lines of English and of other documents."""
    lines = lambda df: df.select(F.explode(F.split("text", "\n")).alias("line"))
    return evaluate.report_diff(lines(t.documents.where("lang = 'en'")), lines(t.documents.where("lang <> 'en'")))


# ---- service -----------------------------------------------------------------------------


@query("calls_rates", "SELECT user_id % 10 AS grp, count(*) AS n, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg((event_type = 'signup')::INT) FILTER (WHERE event_type <> 'error'), 6) AS refusal_rate, round(avg(value / 7), 6) AS mean FROM events GROUP BY 1")
def calls_rates(t: Tables) -> DataFrame:
    """Errors are failed calls; signups stand for refusals."""
    return service.rates(t.events.withColumn("grp", F.col("user_id") % 10), F.col("event_type") == "error", F.col("event_type") == "signup", "grp")


@query("calls_p50_p95", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def calls_p50_p95(t: Tables) -> DataFrame:
    return service.latencies(t.events, exact=True)


@query("calls_p95_approx")
def calls_p95_approx(t: Tables) -> DataFrame:
    return service.latencies(t.events)


#: The codes 0 to 20 in five families: those that leave the same rest.
FAMILIES = ["input", "retrieval", "generation", "constraint", "system"]


@query("calls_sketches")
def calls_sketches(t: Tables) -> DataFrame:
    """Quantiles and distinct users by day and in total, from sketches stored by hour; tests hold them within the sketches' bounds."""
    stored = cut(sketches.hourly(t.events), "sketches")
    days = cut(sketches.merged(stored, F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day"), "event_type"), "sketches")
    total = sketches.merged(days, "event_type").select(F.lit(None).cast("timestamp_ntz").alias("day"), "*")
    return sketches.read(days.unionByName(total), "day", "event_type")


@query("err_families", f"WITH f AS (SELECT i AS code, {FAMILIES}[i % 5 + 1] AS family FROM range(21) r(i)), e AS (SELECT (props->>'k')::BIGINT AS code FROM events WHERE event_type = 'error') SELECT coalesce(family, 'unknown') AS family, count(*) AS n, count(DISTINCT e.code) AS n_codes FROM e LEFT JOIN f USING (code) GROUP BY 1")
def err_families(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in FAMILIES])
    families = t.spark.range(21).select(F.col("id").alias("code"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("family"))
    return service.error_families(t.events.where("event_type = 'error'").select(F.get_json_object("props", "$.k").cast("long").alias("code")), families)


@query("cache_hits", "WITH k AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key FROM documents), f AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY key) AS hit FROM k) SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS n_hits, round(avg(hit::INT), 6) AS rate FROM f")
def cache_hits(t: Tables) -> DataFrame:
    return service.cache_hits(t.documents)


@query("session_context", "SELECT conv_id, turn, role, lag(text) OVER w AS previous, (count(*) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS n_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def session_context(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("text").over(w).alias("previous"), F.count("*").over(w).alias("n_so_far"))


@query("md5_sync", "WITH a AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN text || ' ' ELSE text END) AS h FROM documents WHERE lang <> 'es') SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'stale' ELSE 'same' END AS state FROM a FULL JOIN b USING (doc_id)")
def md5_sync(t: Tables) -> DataFrame:
    """Copies stand for documents, of which German ones were changed and Spanish ones never made."""
    copies = t.documents.where("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"))
    return service.sync_state(t.documents, copies)


@query("calls_export", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || event_type || '|' || user_id AS line FROM events")
def calls_export(t: Tables) -> DataFrame:
    return service.export_lines(t.events)


@query("doc_upsert", "SELECT doc_id, upper(lang) AS lang, source FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang NOT IN ('fr', 'es') UNION ALL SELECT doc_id + 1000000000, lang, source FROM documents WHERE lang = 'de'")
def doc_upsert(t: Tables) -> DataFrame:
    """French rows change, German ones come again under new ids, Spanish ones are deleted."""
    base = t.documents.select("doc_id", "lang", "source")
    changes = base.where("lang = 'fr'").withColumn("lang", F.upper("lang")).unionByName(base.where("lang = 'de'").withColumn("doc_id", F.col("doc_id") + 10**9))
    return service.upsert(base, changes, base.where("lang = 'es'").select("doc_id"), "doc_id")


@query("doc_versions", f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN text || ' second' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 3 = 0), e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'third ' || text ELSE text END AS text FROM d), x AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM e), p AS (SELECT term, doc_id, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(doc_id) AS first_doc FROM p GROUP BY term")
def doc_versions(t: Tables) -> DataFrame:
    """The postings of the fourth version of the documents: loaded, every fifth changed and every seventh deleted, compacted, and some of the deleted ones put back."""
    path = f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}"
    atexit.register(remove_folder, t.spark, path)
    store = versions.Versions(t.spark, path, "doc_id long, text string")
    docs = t.documents.select("doc_id", "text")
    store.upsert(docs)
    fifth = docs.where("doc_id % 5 = 0 and doc_id % 7 <> 0")
    store.upsert(fifth.withColumn("text", F.concat("text", F.lit(" second"))), docs.where("doc_id % 7 = 0"))
    store.compact()
    store.upsert(docs.where("doc_id % 7 = 0 and doc_id % 3 = 0").withColumn("text", F.concat(F.lit("third "), "text")))
    return store.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"))


@query("coalesce_versions", "SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, lang = 'en' AS fresh FROM documents")
def coalesce_versions(t: Tables) -> DataFrame:
    """Fresh versions exist of the English rows; the frozen ones stand in for the others."""
    fresh = t.documents.where("lang = 'en'").select("doc_id", F.upper("source").alias("fresh_source"))
    return service.fresh_or_frozen(fresh, t.documents.select("doc_id", "source"))


@query("join_catalog", f"WITH {RUN} SELECT query_id, doc_id, lang, source, n_chars FROM run JOIN documents USING (doc_id) WHERE rank <= 10")
def join_catalog(t: Tables) -> DataFrame:
    return retrieve.bm25(t.documents, t.benchmark).select("query_id", "doc_id").join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("log_requests", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, substr(md5(event_id::VARCHAR), 1, 12) AS request_id, event_type AS status, value AS latency_ms, 'user ' || coalesce(user_id::VARCHAR, '-') || chr(10) || coalesce(props, '') AS message FROM events")
def log_requests(t: Tables) -> DataFrame:
    """Call records written as a request log, a line each, and read back by their fields."""
    t.spark.dataSource.register(requests.RequestLog)
    message = F.concat(F.lit("user "), F.coalesce(F.col("user_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("props", F.lit("")))
    request = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12)
    lines = t.events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), request.alias("request_id"), F.col("event_type").alias("status"), F.col("value").alias("latency_ms"), message.alias("message"))
    path = f"{shared_folder(t.spark)}/requests-{uuid.uuid4().hex}"
    atexit.register(remove_folder, t.spark, path)
    lines.write.format("request_log").mode("append").save(path)
    return t.spark.read.format("request_log").load(path)



