"""Context assembly: dedup, source diversity, token budget, citation numbers, rendering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens, words
from evidora.operators.links import components, cut


def candidates(run: DataFrame, docs: DataFrame) -> DataFrame:
    """A run (query_id, doc_id, rank, ...) with text, source and token counts of its documents."""
    return run.join(docs.select("doc_id", "text", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens")), "doc_id")


def dedup_exact(ctx: DataFrame) -> DataFrame:
    """Of equal texts in a query's candidates the best ranked stays."""
    w = Window.partitionBy("query_id", F.md5(F.col("text").cast("binary"))).orderBy("rank")
    return ctx.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diverse(ctx: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` candidates of one source per query."""
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    return ctx.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def within_budget(ctx: DataFrame, budget: int = 2000) -> DataFrame:
    """The candidates in rank order as long as their tokens sum to `budget` at most."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ctx.withColumn("used", F.sum("n_tokens").over(w)).where(F.col("used") <= budget)


def numbered(ctx: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return ctx.withColumn("s_no", n).withColumn("cite", F.concat(F.lit("[S"), F.col("s_no"), F.lit("]")))


def assemble(run: DataFrame, docs: DataFrame, per_source: int = 2, budget: int = 2000) -> DataFrame:
    return numbered(within_budget(diverse(dedup_exact(candidates(run, docs)), per_source), budget))


def render(ctx: DataFrame) -> DataFrame:
    """query_id, n_sources, context: the numbered texts of a query, in order, parted by newlines."""
    items = F.array_sort(F.collect_list(F.struct("s_no", "cite", "text")))
    return ctx.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(items, lambda x: F.concat(x["cite"], F.lit(" "), x["text"])), "\n").alias("context"))


#: What a generator is asked, of a question and its rendered context.
PROMPT = "Answer from the sources below and cite them as [S#]; say so if they don't tell.\n\nSources:\n%s\n\nQuestion: %s"


def prompts(rendered: DataFrame, queries: DataFrame, template: str = PROMPT) -> DataFrame:
    """query_id, prompt: the template with context and question; without a context, the sources are `none`."""
    asked = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = asked.join(rendered.select("query_id", "context"), "query_id", "left")
    return out.select("query_id", F.format_string(template, F.coalesce("context", F.lit("none")), F.coalesce("question", F.lit(""))).alias("prompt"))


def similar_candidates(ctx: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of one query's candidates (at most the pool's 50) whose token sets have a Jaccard similarity of `least`."""
    toks = ctx.select("query_id", "doc_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    a, b = toks.select("query_id", F.col("doc_id").alias("a"), F.col("t").alias("ta")), toks.select("query_id", F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    pairs = a.join(b, "query_id").where("a < b")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.withColumn("jaccard", F.round(both / (F.size("ta") + F.size("tb") - both), 6)).where(F.col("jaccard") >= least).select("query_id", "a", "b", "jaccard")


#: A band is the hash of so many MinHash values: at similarity 0.8 a pair has none of the bands in common with a chance of 1 in 100,000.
BANDS, BAND_ROWS = 16, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From keys, ids and lists of shingles (null: none): key, id, number of shingles, bands."""
    seeds = np.random.default_rng(7).integers(0, 2**63, (BANDS, BAND_ROWS)).astype(np.uint64)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            some = batch.column(2).is_valid()
            lists = batch.column(2).filter(some)
            values, sizes = lists.flatten().to_numpy().view(np.uint64), pc.list_value_length(lists).to_numpy()
            starts = np.cumsum(sizes) - sizes
            bands = np.empty((len(sizes), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for i, seed_row in enumerate(seeds if len(sizes) else ()):
                    bands[:, i] = _mixed(seed_row[:1])
                    for seed in seed_row:
                        bands[:, i] = _mixed(bands[:, i] + np.minimum.reduceat(_mixed(values ^ seed), starts))
            none = ~some.to_numpy(zero_copy_only=False)
            place = pa.array(np.cumsum(~none) - 1, mask=none)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()).take(place), found.take(place)], names=["k", "doc_id", "n", "bands"])


#: So many members of a bucket are compared with all others of it.
PIVOTS = 4


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs of keys (k1, k2), those whose sets have a Jaccard similarity of `least`, counted exactly."""
    one, two = (sets.select(F.col("k").alias(f"k{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    both = F.size(F.array_intersect("s1", "s2"))
    pairs = pairs.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    out = pairs.join(one, "k1").join(two, "k2").select("k1", "k2", both.alias("both"), (F.size("s1") + F.size("s2") - both).alias("all"))
    return cut(out.where(F.col("both") >= least * F.col("all") - 1e-9).select(F.col("k1").alias("a"), F.col("k2").alias("b")), "linked")


def dedup_minhash(docs: DataFrame, distance: float = 0.2) -> DataFrame:
    """doc_id, class_id (the smallest id with the same text; null counts as empty) and component_id (the smallest id that chains of near
    texts lead to), a row for each document. Texts are near if their sets of five-token shingles have a Jaccard distance
    of at most `distance`, which is counted exactly (shingles as 64-bit hashes); MinHash bands say which are compared. Texts of fewer than
    five tokens are near to none. An id is null where no document of the class or component has one.

    Of a bucket, some pivots are compared with all members, and what this doesn't connect with most of the bucket is then compared with
    all members that it isn't connected with. So every two members are compared or connected, and a bucket of n near copies costs some n
    comparisons, not n squared; buckets whose members are mostly not near cost up to the square.
    (Over single tokens, texts of one language share so many that the bands would pair most of them.)"""
    least = 1 - distance
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.unhex(F.md5(F.col("text").cast("binary"))))
    shingles = F.expr("CASE WHEN size(w) >= 5 THEN array_distinct(transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5)))) END")
    kinds = f"k binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, bands array<long>"
    signed = rows.select("k", "doc_id", tokens(F.col("text")).alias("w")).select("k", "doc_id", shingles.alias("s")).mapInArrow(_bands, kinds)
    classes = cut(signed.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("k", "n", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = cut(banded.join(cut(sizes, "sizes"), "band"), "buckets")
    # only texts that share a band with another are ever compared: of the others neither text nor shingles are written down
    asked = rows.select("k", "text").join(buckets.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    sets = cut(asked.select("k", tokens(F.col("text")).alias("w")).select("k", shingles.alias("s")), "sets")
    near = F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9  # sets of other sizes can't be
    first = buckets.withColumn("_n", F.row_number().over(Window.partitionBy("band").orderBy("k"))).where(F.col("_n") <= PIVOTS)
    met = buckets.join(first.select("band", F.col("k").alias("k2"), F.col("n").alias("n2")), "band").where((F.col("k") != F.col("k2")) & near)
    roots = components(_linked(met.select(F.col("k").alias("k1"), "k2"), sets, least))
    large = buckets.where(F.col("members") > PIVOTS + 1).join(roots, F.col("k") == F.col("node"), "left")
    large = cut(large.select("band", "k", "n", F.coalesce("root", "k").alias("label")), "large")
    most = large.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "label")).alias("most"))
    rest = large.join(most, "band").where(F.col("label") != F.col("most.label")).select("band", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    met = large.join(cut(rest, "rest"), "band").where((F.col("label") != F.col("label2")) & near)
    more = _linked(met.select(F.col("k").alias("k1"), "k2"), sets, least)
    roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = classes.select("k", "class_id").join(roots, F.col("k") == F.col("node"), "left").select("k", "class_id", F.coalesce("root", "k").alias("comp"))
    named = cut(named, "named")
    ids = cut(named.groupBy("comp").agg(F.min("class_id").alias("component_id")), "ids")
    named = named.join(ids, "comp").select("k", "class_id", "component_id")
    return rows.select("k", "doc_id").join(named, "k").select("doc_id", "class_id", "component_id")
