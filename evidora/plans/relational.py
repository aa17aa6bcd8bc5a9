"""Queries of relational operators and function families over the star schema and the events."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators import inequality, relational
from evidora.plans.base import Tables, query


@query("filter_project", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200 AND source IN ('src1', 'src2', 'src3')")
def filter_project(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en' AND n_chars >= 200 AND source IN ('src1', 'src2', 'src3')").select("doc_id", "source", "n_chars")


JOINED = "SELECT o_orderpriority, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


def _joined(t: Tables, hint: str) -> DataFrame:
    out = t.orders.select("o_orderkey", "o_orderpriority").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").hint(hint), "o_orderkey")
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("join_smj", JOINED)
def join_smj(t: Tables) -> DataFrame:
    return _joined(t, "merge")


@query("join_shj", JOINED)
def join_shj(t: Tables) -> DataFrame:
    return _joined(t, "shuffle_hash")


@query("join_asof", "WITH e AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY ALL), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT l.event_id, l.user_id, e.last_value FROM l ASOF LEFT JOIN e ON l.user_id = e.user_id AND l.ts >= e.ts")
def join_asof(t: Tables) -> DataFrame:
    """The last purchase of a user before each of the user's errors."""
    e = t.events
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return relational.asof(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "last_value").select("event_id", "user_id", "last_value")


@query("join_asof_sliced", "WITH s AS (SELECT client_id, sold_at AS ts, max(total) AS total FROM sales WHERE total IS NOT NULL AND client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL) SELECT click_id, c.client_id, c.ts, total FROM clicks c ASOF LEFT JOIN s ON s.client_id = c.client_id AND s.ts <= c.ts")
def join_asof_sliced(t: Tables) -> DataFrame:
    """Each click with its client's last sale; a client may hold any share of the rows."""
    return inequality.asof(t.clicks.select("click_id", "client_id", "ts"), t.sales.select("client_id", F.col("sold_at").alias("ts"), "total"), "client_id", "ts", "total")


@query("join_band", "SELECT client_id, c.balance, vendor_id, v.balance AS vendor_balance FROM clients c JOIN vendors v ON v.balance >= c.balance - 5 AND v.balance <= c.balance + 5")
def join_band(t: Tables) -> DataFrame:
    """Clients and vendors with nearly the same balance: an inequality join by range buckets."""
    vendors = t.vendors.select("vendor_id", F.col("balance").alias("vendor_balance"))
    return inequality.band(t.clients.select("client_id", "balance"), vendors, F.col("balance"), F.col("vendor_balance"), -5, 5)


@query("join_theta_count", "WITH b AS (SELECT balance FROM clients WHERE balance IS NOT NULL) SELECT sale_id, total, CASE WHEN total IS NOT NULL THEN (SELECT count(*) FROM b WHERE balance > total) END AS n_above FROM sales")
def join_theta_count(t: Tables) -> DataFrame:
    """For each sale the number of clients with a larger balance: an inequality join that is counted, not made."""
    return inequality.counted_above(t.sales.select("sale_id", "total"), t.clients, "total", "balance")


@query("join_interval", "WITH s AS (SELECT event_id AS signup, ts AS a, ts + INTERVAL 30 MINUTE AS b FROM events WHERE event_type = 'signup') SELECT signup, count(*) AS n, min(event_id) AS first_event FROM s JOIN events e ON e.ts >= a AND e.ts < b GROUP BY signup")
def join_interval(t: Tables) -> DataFrame:
    e = t.events
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("b"))
    out = relational.interval(e.select("event_id", "ts"), spans, "ts", "a", "b", 1800)
    return out.groupBy("signup").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_basic(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("agg_acd")
def agg_acd(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("agg_rollup", "SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def agg_rollup(t: Tables) -> DataFrame:
    o = t.orders.select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))
    return o.rollup("y", "m").agg(F.count("*").alias("n"))


@query("agg_gsets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_gsets(t: Tables) -> DataFrame:
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("g"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_events", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY user_id")
def pivot_events(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", TYPES).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot_events", "SELECT s_suppkey, 'balance' AS name, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivot_events(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "name", "v")


@query("win_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
def win_rank(t: Tables) -> DataFrame:
    a = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    b = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    return t.customer.select("c_custkey", F.row_number().over(a).cast("long").alias("rn"), F.rank().over(b).cast("long").alias("r"), F.dense_rank().over(b).cast("long").alias("dr"), F.ntile(4).over(a).cast("long").alias("quarter"))


@query("win_dist", "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)")
def win_dist(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal")
    return t.customer.select("c_custkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("win_lag", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(value, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("value").over(w).alias("first"), F.nth_value("value", 3).over(w).alias("third"))


@query("win_range", "SELECT event_id, (count(*) OVER w)::BIGINT AS n, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def win_range(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return t.events.withColumn("us", us).select("event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 6).alias("total"))


@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_global(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("topk_group", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def topk_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 5").drop("rn")


def _sql(name: str, sql: str, *tables: str) -> None:
    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        text, of = sql, hashlib.md5(t._dir.encode()).hexdigest()[:12]  # views by directory, so that queries over two don't meet
        for table in tables:
            getattr(t, table).createOrReplaceTempView(f"{table}_{of}")
            text = re.sub(rf"\b{table}\b", f"{table}_{of}", text)
        return t.spark.sql(text)


_sql("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)", "orders")
_sql("subq_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "customer", "orders", "nation")
_sql("subq_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", "customer", "orders")
_sql("cte_basic", "WITH r AS (SELECT n_regionkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey) SELECT r_name, n FROM r JOIN region ON r_regionkey = n_regionkey", "nation", "supplier", "region")
_sql("cte_recursive", "WITH RECURSIVE d AS (SELECT DISTINCT client_id, master_id FROM clients), r(client_id, root, depth) AS (SELECT client_id, client_id, CAST(0 AS BIGINT) FROM d WHERE master_id = client_id UNION ALL SELECT d.client_id, r.root, r.depth + 1 FROM r JOIN d ON d.master_id = r.client_id WHERE d.client_id <> d.master_id) SELECT client_id, root, depth FROM r", "clients")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")


# ---- scalar function families ------------------------------------------------------------


@query("fn_string", "SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 3, 4) AS sub, levenshtein(p_name, p_type)::BIGINT AS lev, replace(p_type, ' ', '_') AS rep, lpad(p_brand, 12, '*') AS pad, regexp_extract(p_brand, '([0-9]+)', 1) AS num, reverse(p_name) AS rev, contains(p_type, 'a') AS has FROM part")
def fn_string(t: Tables) -> DataFrame:
    n, b, y = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", F.upper(n).alias("up"), F.substring(b, 3, 4).alias("sub"), F.levenshtein(n, y).cast("long").alias("lev"), F.replace(y, F.lit(" "), F.lit("_")).alias("rep"), F.lpad(b, 12, "*").alias("pad"), F.regexp_extract(b, "([0-9]+)", 1).alias("num"), F.reverse(n).alias("rev"), F.contains(y, F.lit("a")).alias("has"))


@query("fn_text_norm", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm, length(text)::BIGINT AS n, strlen(text)::BIGINT AS n_bytes, md5(translate(text, '.,', ';:')) AS tr FROM documents")
def fn_text_norm(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")).cast("binary")).alias("norm"), F.length(x).cast("long").alias("n"), F.octet_length(x).cast("long").alias("n_bytes"), F.md5(F.translate(x, ".,", ";:").cast("binary")).alias("tr"))


@query("fn_date", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS days, strftime(o_orderdate, '%Y/%m/%d') AS f, dayofyear(o_orderdate)::BIGINT AS doy FROM orders")
def fn_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("m"), F.date_diff(F.to_date(d), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(d, "yyyy/MM/dd").alias("f"), F.dayofyear(d).cast("long").alias("doy"))


@query("fn_math", "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s, round(pow(p_size, 1.5), 6) AS p, floor(p_retailprice / 7)::BIGINT AS f, ceil(p_retailprice / 7)::BIGINT AS c, (p_partkey % 7)::BIGINT AS m, abs(p_size - 25)::BIGINT AS a FROM part")
def fn_math(t: Tables) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    return t.part.select("p_partkey", F.round(F.log(p), 6).alias("l"), F.round(F.sqrt(p), 6).alias("s"), F.round(F.pow(s, 1.5), 6).alias("p"), F.floor(p / 7).alias("f"), F.ceil(p / 7).alias("c"), F.pmod("p_partkey", F.lit(7)).alias("m"), F.abs(s - 25).cast("long").alias("a"))


@query("fn_array", "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_max(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS hi, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_pos, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head, len(list_filter(embedding, lambda x: x > 1)) > 0 AS big, round(embedding[3]::DOUBLE, 6) AS third FROM embeddings")
def fn_array(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.array_max(e), 6).alias("hi"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_pos"), F.round(F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, x: a + x), 6).alias("head"), F.exists(e, lambda x: x > 1).alias("big"), F.round(F.element_at(e, 3), 6).alias("third"))


@query("fn_map", "WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS k FROM documents), m AS (SELECT doc_id, k, count(*) AS v FROM x GROUP BY ALL) SELECT doc_id, k, v FROM m WHERE v >= 5")
def fn_map(t: Tables) -> DataFrame:
    """Term counts as a map, filtered as a map, and exploded. The texts of an id are shuffled, not a row for each of their terms."""
    @F.udf("map<string,bigint>", useArrow=True)
    def counted(terms):
        return dict(Counter(terms))

    texts = t.documents.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    maps = texts.select("doc_id", counted(F.flatten(F.transform("texts", tokens))).alias("m"))
    return maps.select("doc_id", F.explode(F.map_filter("m", lambda k, v: v >= 5)).alias("k", "v"))


@query("fn_json", "SELECT event_id, (props->>'k')::BIGINT AS k, '{\"k\":' || (props->>'k') || ',\"type\":\"' || event_type || '\"}' AS j FROM events")
def fn_json(t: Tables) -> DataFrame:
    p = F.from_json("props", "k long")
    return t.events.select("event_id", p["k"].alias("k"), F.to_json(F.struct(p["k"].alias("k"), F.col("event_type").alias("type"))).alias("j"))


@query("fn_variant", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def fn_variant(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("fn_xml", "SELECT p_partkey, p_brand AS brand, p_size AS size, p_type AS type FROM part")
def fn_xml(t: Tables) -> DataFrame:
    """Written as XML and read again, by a schema and by a path."""
    x = F.format_string("<r><brand>%s</brand><size>%d</size><sec><type>%s</type></sec></r>", "p_brand", "p_size", "p_type")
    rows = t.part.select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.from_xml("x", "brand string, size int").alias("r"), F.xpath_string("x", F.lit("r/sec/type")).alias("type")).select("p_partkey", "r.brand", "r.size", "type")


@query("fn_hash", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def fn_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.sha2(F.col("text").cast("binary"), 256).alias("s"))


@query("fn_url", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def fn_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"), F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"))
