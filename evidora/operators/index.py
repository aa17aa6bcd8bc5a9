"""A stored inverted index with block bounds, and BM25 top-k that reads only the blocks which can matter.

The store has three tables: `blocks`, postings cut by term and by window of documents, each block in the order of impact with its largest weight first; `terms`, document
frequency and largest weight; `stats`, one row. Blocks and terms are partitioned by a hash of the term. A posting has its term
frequency and its document's length, small numbers that store well; its weight is BM25's factor of them without the inverse document frequency."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators.links import cut
from evidora.operators.retrieve import query_terms, ranked
from evidora.sources.files import open_index, remove_folder, shared_folder

#: Scores are rounded to six digits before they rank: what is nearer than this may tie.
TIES = 2e-6
BLOCKS = "term string, window long, n int, most double, ids array<long>, tfs array<int>, dls array<int>, bucket int"
PAYLOAD = ["window", "ids", "tfs", "dls"]
#: Windows whose blocks of one bucket a task writes, some.
PART = 8192


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _weight(tf, dl, k1: float, b: float, avgdl: float):
    """BM25's factor of a posting, of columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


#: The blocks that one bucket has of one window, side by side: of each its term, number of postings and largest weight, of all the postings.
PACKED = "bucket int, window long, terms array<string>, ns array<int>, mosts array<double>, ids array<long>, tfs array<int>, dls array<int>"


def _window_blocks(buckets: int, factors: tuple[float, float, float]):
    """Rows (window, doc_id, t) in the order of windows to PACKED rows."""
    def blocks(window: int, part: pa.Table) -> pa.RecordBatch | None:
        lists = part.column(2).combine_chunks()
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return None
        words, size = flat.dictionary, len(flat.dictionary)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        seen, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + flat.indices.to_numpy(), return_counts=True)
        doc, code = seen // size, seen % size
        ids, dl = part.column(0).to_numpy()[doc], sizes[doc]
        weight = _weight(tf, dl, *factors)
        bucket = np.array([crc32(w.encode()) % buckets for w in words.to_pylist()])
        by = np.argsort(bucket, kind="stable")  # terms, bucket by bucket
        place = np.empty(size, np.int64)
        place[by] = np.arange(size)
        order = np.lexsort((ids, -weight, place[code]))
        n = np.bincount(code, minlength=size)[by]
        most = weight[order][np.cumsum(n) - n]
        kinds, per_bucket = np.unique(bucket, return_counts=True)
        posts = np.add.reduceat(n, np.cumsum(per_bucket) - per_bucket)
        of_terms = (words.take(pa.array(by)), pa.array(n.astype(np.int32)), pa.array(most))
        of_posts = (pa.array(ids[order]), pa.array(tf[order].astype(np.int32)), pa.array(dl[order].astype(np.int32)))
        columns = [pa.array(kinds.astype(np.int32)), pa.array(np.full(len(kinds), window)), *(_lists(x, per_bucket) for x in of_terms), *(_lists(x, posts) for x in of_posts)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            window = batch.column(0).to_numpy()
            bounds = np.append(np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])), len(window)) if len(window) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if window[lo] != now and held:
                    if (out := blocks(now, pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                now = window[lo]
                held.append(batch.select([1, 0, 2]).slice(lo, hi - lo))
        if held and (out := blocks(now, pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED rows to a row for each block."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            bucket, window, terms, ns, mosts, *posts = some.columns
            n, per_row = ns.flatten().to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False)
            columns = [terms.flatten(), pa.array(np.repeat(window.to_numpy(), per_row)), pa.array(n), mosts.flatten(), *(_lists(x.flatten(), n) for x in posts), pa.array(np.repeat(bucket.to_numpy(), per_row))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (BLOCKS) to PACKED ones: what lies together of a window becomes a row, so that a shuffle moves few, dense rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term, window, n, most, *posts, bucket = batch.columns
        w, n = window.to_numpy(), n.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        per_row, held = np.diff(np.append(heads, len(w))), np.add.reduceat(n, heads)
        columns = [bucket.take(pa.array(heads)), pa.array(w[heads]), *(_lists(x, per_row) for x in (term, pa.array(n), most)), *(_lists(x.flatten(), held) for x in posts)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])


def build(docs: DataFrame, path: str, window: int = 128, buckets: int = 64, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of docs (distinct ids; null texts have length 0 and no postings) to path.

    A document's window is a hash of its id, of so many windows that each holds about `window` documents: the term that all documents have is
    spread over all windows, and no task holds more of a term than one window's postings. Texts are dealt to their windows, a task makes the blocks of one window at
    a time, and these go to their bucket's files packed, a row for each window and bucket, not one for each posting or block. The stats are written last: a store without them isn't whole."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lengths = texts.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens(F.col("text")))), F.lit(0.0)).alias("avgdl")).first()  # two numbers
    n, avgdl = lengths["n"], lengths["avgdl"]
    most_windows = max(1, -(-n // window))
    dealt = texts.withColumn("window", F.pmod(F.xxhash64("doc_id"), F.lit(most_windows))).repartition("window").sortWithinPartitions("window", "doc_id")
    packed = dealt.select("window", "doc_id", tokens(F.col("text")).alias("t")).mapInArrow(_window_blocks(buckets, (k1, b, avgdl or 1.0)), PACKED)
    part = F.pmod(F.xxhash64("window"), F.lit(-(-most_windows // PART)))
    blocks = packed.repartition("bucket", part).mapInArrow(_unpacked, BLOCKS)
    blocks.sortWithinPartitions("bucket", "window").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    heads = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    windows = heads.select("window").distinct().count()
    terms = heads.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms.withColumn("idf", idf).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    stats = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(float(avgdl)).alias("avgdl"), F.lit(windows).cast("long").alias("windows"), F.lit(buckets).alias("buckets"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


class Index:
    """A store of build(). One that is missing or not whole fails here, an empty one when it is searched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        stats = open_index(spark, f"{path}/stats").first()
        self.n, self.windows, self.buckets = stats["n"], stats["windows"], stats["buckets"]
        self.factors = stats["k1"], stats["b"], stats["avgdl"] or 1.0

    @property
    def terms(self) -> DataFrame:
        """bucket, term, df, most, idf."""
        return self.spark.read.schema("term string, df long, most double, idf double, bucket int").parquet(f"{self.path}/terms")

    @property
    def blocks(self) -> DataFrame:
        """bucket, term, window, n, most, ids, tfs, dls."""
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")


_stores: dict[tuple, str] = {}


def stored(docs: DataFrame, name: str, **options) -> Index:
    """The index of docs in the shared folder: built at the first call for a name and kept for the session, so that every later search reads it."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name, *sorted(options.items()))
    if key not in _stores:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        atexit.register(remove_folder, spark, path)
        build(docs, path, **options)
        _stores[key] = path
    return Index(spark, _stores[key])


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """query_id, least: the k-th best score of each query that has as many; each task limits its own before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    best = scores.withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("query_id").agg(F.min("score").alias("least"), F.max("place").alias("has")).where(F.col("has") == k).select("query_id", "least")


def _postings(blocks: DataFrame, index: Index) -> DataFrame:
    each = blocks.select("query_id", "window", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    return each.select("query_id", "window", F.col("p.ids").alias("doc_id"), (F.col("idf") * _weight(F.col("p.tfs"), F.col("p.dls"), *index.factors)).alias("score"))


class Search:
    """A search in its steps; run() gives the ranked documents, plan() which blocks each step reads.

    A query's terms are taken by their upper bounds (inverse document frequency x largest weight), largest first. The first ones, up to the share `first` of the
    query's total bound, are read whole: their partial sums give a threshold, the k-th best. Terms of which the rest's bound still reaches the threshold are read
    whole, too. No document without one of these can be among the best k. What is left, mostly the frequent terms, is read for candidates only: the
    headers of blocks in the candidates' windows bound what a candidate can still get, and the blocks of those that can still reach the threshold complete their
    scores. Exact, ties included: nothing that can reach the k-th place is left out. Partial sums are written down, everything else is joins.

    Bounds add up: with many terms their sum lies far above any document's score, and little can be skipped. This is for queries of few terms; see whole() for long ones."""

    def __init__(self, index: Index, terms: DataFrame, k: int = 10, first: float = 0.6):
        """terms: of known_terms()."""
        self.index, self.k = index, k
        one = Window.partitionBy("query_id")  # the terms of one query
        known = terms.withColumn("bound", F.col("idf") * F.col("most"))
        known = known.withColumn("upto", F.sum("bound").over(one.orderBy(F.desc("bound"), "term").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("bound").over(one))
        self.terms = cut(known.withColumn("leads", F.col("upto") - F.col("bound") < first * F.col("total")), "query-terms")
        led = self._whole(self.terms.where("leads"))
        self.led = cut(led.groupBy("query_id", "window", "doc_id").agg(F.sum("score").alias("score")), "led")
        rest = F.col("total") - F.col("upto") + F.col("bound")
        follow = self.terms.where("not leads").join(_kth(self.led, k), "query_id", "left").withColumn("whole", rest >= F.coalesce("least", F.lit(0.0)) - TIES)
        self.follow = cut(follow.select("query_id", "bucket", "term", "idf", "bound", "whole"), "follow")
        more = self._whole(self.follow.where("whole"))
        self.partial = cut(self.led.unionByName(more).groupBy("query_id", "window", "doc_id").agg(F.sum("score").alias("score")), "partial")
        self.least = _kth(self.partial, k)
        self.others = self.follow.where("not whole")

    def _of(self, terms: DataFrame, columns: list[str]) -> DataFrame:
        return self.index.blocks.select("bucket", "term", *columns).join(terms.select("query_id", "bucket", "term", "idf"), ["bucket", "term"])

    def _whole(self, terms: DataFrame) -> DataFrame:
        return _postings(self._of(terms, PAYLOAD), self.index)

    def _completing(self, terms: DataFrame, docs: DataFrame) -> DataFrame:
        """The postings of terms in docs (query_id, window, doc_id), from the blocks of their windows."""
        read = self._of(terms, PAYLOAD).join(docs.select("query_id", "window").distinct(), ["query_id", "window"], "left_semi")
        return _postings(read, self.index).join(docs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")

    def candidates(self) -> DataFrame:
        """query_id, window, doc_id, score: documents that can still be among the best, by the headers of blocks alone."""
        left = self.others.groupBy("query_id").agg(F.sum("bound").alias("left"))
        out = self.partial.join(self.least, "query_id", "left").join(left, "query_id", "left")
        reach = F.coalesce("least", F.lit(0.0)) - TIES
        out = out.where(F.col("score") + F.coalesce("left", F.lit(0.0)) >= reach)
        heads = self._of(self.others, ["window", "most"]).join(out.select("query_id", "window").distinct(), ["query_id", "window"], "left_semi")
        within = heads.groupBy("query_id", "window").agg(F.sum(F.col("idf") * F.col("most")).alias("within"))
        out = out.join(within, ["query_id", "window"], "left")
        return out.where(F.col("score") + F.coalesce("within", F.lit(0.0)) >= reach).select("query_id", "window", "doc_id", "score")

    def run(self) -> DataFrame:
        """query_id, doc_id, score, rank."""
        some = cut(self.candidates(), "candidates")
        more = self._completing(self.others, some)
        both = some.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")).where("score > 0")
        return ranked(both, self.k)

    def plan(self) -> DataFrame:
        """query_id, n_blocks, n_read: blocks of the query's terms, and those that are read with their postings."""
        every = self._of(self.terms, ["window"]).groupBy("query_id").agg(F.count("*").alias("n_blocks"))
        whole = self._of(self.terms.where("leads").unionByName(self.follow.where("whole"), allowMissingColumns=True), ["window"])
        some = self._of(self.others, ["window"]).join(self.candidates().select("query_id", "window").distinct(), ["query_id", "window"], "left_semi")
        parts = [x.select("query_id", "bucket", "term", "window") for x in (whole, some)]
        read = parts[0].unionByName(parts[1]).groupBy("query_id").agg(F.count("*").alias("n_read"))
        return every.join(read, "query_id", "left").select("query_id", "n_blocks", F.coalesce("n_read", F.lit(0).cast("long")).alias("n_read"))


def known_terms(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, bucket, term, idf, most, n_terms: the distinct terms of each query that the index has, and their number."""
    terms = query_terms(queries, id_col, text_col).withColumn("bucket", _bucket(F.col("term"), index.buckets))
    known = terms.join(index.terms, ["bucket", "term"]).select("query_id", "bucket", "term", "idf", "most")
    return known.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def _window_scorer(shared, k: int, factors: tuple[float, float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vocabulary, weights = shared.value  # ids; term -> column; queries x terms, inverse document frequencies
        best = np.full((len(queries), k), -1.0)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)

        def score(term: list, most: list, ids: list, w: list) -> None:
            """One window: queries whose bound doesn't reach their k-th best so far are left out."""
            q = weights[:, [vocabulary[t] for t in term]]
            some = np.flatnonzero((q @ np.array(most) >= best[:, -1] - TIES) & (q.any(axis=1)))
            flat = np.concatenate(ids)
            docs, place = np.unique(flat, return_inverse=True)
            m = np.zeros((len(term), len(docs)))
            m[np.repeat(np.arange(len(term)), [len(i) for i in ids]), place] = np.concatenate(w)
            s = np.round(q[some] @ m, 6)
            s[s <= 0] = -1.0
            values, names = np.concatenate([best[some], s], axis=1), np.concatenate([best_ids[some], np.broadcast_to(docs, s.shape)], axis=1)
            order = np.lexsort((names, -values), axis=1)[:, :k]
            best[some], best_ids[some] = np.take_along_axis(values, order, axis=1), np.take_along_axis(names, order, axis=1)

        now, held = None, ([], [], [], [])
        for batch in batches:
            for row in range(batch.num_rows):
                window, terms, ns, mosts, ids, tf, dl = (batch.column(c)[row] for c in range(1, 8))
                if window.as_py() != now and held[0]:
                    score(*held)
                    held = ([], [], [], [])
                now = window.as_py()
                ns = ns.values.to_numpy()
                held[0].extend(terms.as_py())
                held[1].extend(mosts.values.to_numpy())
                at = np.cumsum(ns)[:-1]
                held[2].extend(np.split(ids.values.to_numpy(), at))
                held[3].extend(np.split(_weight(tf.values.to_numpy(), dl.values.to_numpy(), *factors), at))
        if held[0]:
            score(*held)
        q, i = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(best_ids[q, i]), pa.array(best[q, i])], names=["query_id", "doc_id", "score"])

    return run


def whole(index: Index, terms: DataFrame, k: int, most_numbers: int = 1 << 23) -> DataFrame:
    """query_id, doc_id, score: candidates for the k best of each query, for queries of many terms. terms: of known_terms().

    The stated queries go in groups of bounded size (queries x terms numbers at most), each a pass: the blocks of the group's terms are shuffled once to their windows, not
    once for every query, and a task scores a window at a time as one product, leaving out queries whose bound there is under their k-th best so far. A task hands
    on k rows for each query."""
    spark = index.spark
    rows = cut(terms.select("query_id", "bucket", "term", "idf").repartition("query_id").sortWithinPartitions("query_id"), "long-queries")
    found = None

    def one_pass(group: list) -> DataFrame:
        queries, q = np.unique(np.array([r["query_id"] for r in group]), return_inverse=True)
        names = sorted({(r["bucket"], r["term"]) for r in group})
        vocabulary = {t: i for i, (_, t) in enumerate(names)}
        weights = np.zeros((len(queries), len(names)))
        weights[q, [vocabulary[r["term"]] for r in group]] = [r["idf"] for r in group]
        shared = spark.sparkContext.broadcast((queries, vocabulary, weights))
        wanted = spark.createDataFrame(names, "bucket int, term string")
        read = index.blocks.join(F.broadcast(wanted), ["bucket", "term"], "left_semi")  # a group's terms, bounded by most_numbers
        packed = read.select(*[x.split()[0] for x in BLOCKS.split(", ")]).mapInArrow(_repacked, PACKED)
        dealt = packed.repartition("window").sortWithinPartitions("window")
        return dealt.mapInArrow(_window_scorer(shared, k, index.factors), "query_id long, doc_id long, score double")

    group, terms_seen, queries_seen = [], set(), set()
    for r in rows.toLocalIterator():  # the queries' terms, a group at a time
        if r["query_id"] not in queries_seen and (len(queries_seen) + 1) * len(terms_seen) > most_numbers:
            part = cut(one_pass(group), "scored")
            found = part if found is None else found.unionByName(part)
            group, terms_seen, queries_seen = [], set(), set()
        group.append(r)
        terms_seen.add(r["term"])
        queries_seen.add(r["query_id"])
    last = one_pass(group) if group else spark.createDataFrame([], "query_id long, doc_id long, score double")
    return last if found is None else found.unionByName(last)


def search(index: Index, queries: DataFrame, k: int = 10, first: float = 0.6, most_terms: int = 16, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query by BM25, exactly, from the store: queries of up to most_terms known terms by Search, longer ones by
    whole(). Queries without a known term have no rows."""
    terms = cut(known_terms(index, queries, id_col, text_col), "terms")
    short, long = terms.where(F.col("n_terms") <= most_terms), terms.where(F.col("n_terms") > most_terms)
    parts = []
    if short.limit(1).count():
        parts.append(Search(index, short, k, first).run().select("query_id", "doc_id", "score"))
    parts.append(whole(index, long, k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, k)
