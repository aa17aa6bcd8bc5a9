"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.llm.common import WORD, cut, free

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sizes: source, source_size. Adds w and target, a number of words.

    The sources by code point, null last, weigh weights[0], weights[1], ... in turn and share
    total_share of all sizes; no target passes most times its source's size, and what is over
    goes to the others by weight. That is min(cap, level * w) with one level for all: by
    growing cap / w, sources are full as long as the level that the rest would have reaches
    their cap. One row a source, so these windows hold as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "nr")
    everything = Window.partitionBy()
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nr") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("nr", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    out = out.withColumn("total", total_share * F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    out = out.withColumn("level", level)
    out = out.withColumn("rank", F.row_number().over(by_ratio))
    held = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("rank", "level"))).over(everything)["level"]
    out = out.withColumn("held", held)
    target = F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("held") * F.col("w")))
    return out.withColumn("target", target).select("source", "nr", "w", "source_size", "n_docs", "target")


def mix(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, taken for every row of docs.

    Every document draws a key from the MD5 of seed and id. Within its source, documents are
    range-partitioned by key into about sqrt(n) ranges of about sqrt(n) documents: keys are
    uniform, so the ranges are known without a look at the data, and the largest source is
    split as finely as it needs. Sizes are summed by range, then over the ranges, then within
    each range; so each document knows how many words come before it. A source whose budget
    is e epochs and r words takes every document e times, then words in key order up to exactly r: the
    document that the cut falls in gives its first words.

    Null text: size 0. Null source: a source of its own. An empty table: an empty result. Rows that
    repeat id and size are interchangeable; ties of keys go by id, then size. Other columns of
    docs are ignored."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), total_share, most)
    plan = cut(plan.withColumn("parts", F.ceil(F.sqrt("n_docs"))), "targets")
    named = plan.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("part", F.floor(F.col("key") / F.lit(float(16**13)) * F.col("parts")).cast("long"))
    parts = rows.groupBy("nr", "part").agg(F.sum("size").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("nr").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("nr").alias("_nr"), F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("start"))
    rows = rows.join(starts, (F.col("nr") == F.col("_nr")) & (F.col("part") == F.col("_part")))
    inner = F.sum("size").over(Window.partitionBy("nr", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ahead", F.col("start") + F.coalesce(inner, F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each whole epoch of a document, and one with its
    first words where the cut falls in it (up to the end of the last word taken). Documents
    without words are taken once as they are: the mix counts words, and they have none. The
    columns are those of docs."""
    i_, size_, taken_, words_, nr_ = free(docs, "_id", "_size", "_taken", "_words", "_nr")
    plan = mix(docs, seed, id_col, text_col, source_col).select(F.col("doc_id").alias(i_), F.col("size").alias(size_), F.col("taken").alias(taken_))
    plan = cut(plan, "plan")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col(id_col).eqNullSafe(F.col(i_)) & (size == F.col(size_))
    rows = docs
    if plan.groupBy(i_, size_).count().where("count > 1").limit(1).count():  # rows alike in id and size are dealt the plan's rows one by one
        plan = plan.withColumn(nr_, F.row_number().over(Window.partitionBy(i_, size_).orderBy(taken_)))
        rows = docs.withColumn(nr_, F.row_number().over(Window.partitionBy(id_col, size).orderBy(F.xxhash64(text_col))))
        same = same & (rows[nr_] == plan[nr_])
    rows = rows.join(plan, same)
    share = F.col(taken_)
    full = F.when(F.col(size_) > 0, F.floor(share / F.col(size_))).otherwise(F.lit(1))
    part = F.when(F.col(size_) > 0, share % F.col(size_)).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(words_, F.explode(copies))
    space = r"[\x20\x09-\x0D]"
    parts = F.split(F.col(text_col), rf"(?<={space})(?=[^\x20\x09-\x0D])")  # each word with the space after it
    leading = F.when(F.col(text_col).rlike("^" + space), 1).otherwise(0)
    clipped = F.regexp_replace(F.array_join(F.slice(parts, 1, (F.greatest(F.col(words_), F.lit(0)) + leading).cast("int")), ""), space + "+$", "")
    text = F.when(F.col(words_) < 0, F.col(text_col)).otherwise(clipped)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM s),
b AS (SELECT *, CASE nr % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY cap / w, nr) AS o, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_below,
  coalesce(sum(w) OVER (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_below FROM b),
e AS (SELECT *, (total - cap_below) / (all_w - w_below) AS level FROM c),
h AS (SELECT level AS held FROM e WHERE level * w < cap ORDER BY o LIMIT 1),
t AS (SELECT e.*, CASE WHEN (SELECT held FROM h) IS NULL THEN cap ELSE least(cap, (SELECT held FROM h) * w) END AS target FROM e),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY t.nr ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - ahead)) ELSE 0 END)::BIGINT AS taken, source
FROM r
"""
