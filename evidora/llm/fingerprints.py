"""Document fingerprints: I-Match over several randomised lexicon subsets, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import cut, numbered

#: Of each lexicon subset, one in so many terms of the band is kept.
RATES = (4,) * 8 + (16,) * 16 + (64,) * 16 + (256,) * 20
#: Most terms of a lexicon that is broadcast (some 64 MB); a larger one is joined by shuffle.
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """The distinct terms, as 64-bit hashes: runs of letters and digits of the lower-case text.
    (Of arrays of longs Spark finds the distinct values by hashing, of strings by comparing all.)"""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(found, lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def lexicon(texts: DataFrame, n_docs: int, least: float = 0.001, most: float = 0.02) -> DataFrame:
    """term, mask: the terms that least to most of the documents have (two documents at least),
    with bit i of the mask for lexicon subset i. Subset i keeps a term if its hash under seed i
    is 0 modulo RATES[i]. A document has so many distinct terms on average, say d; then no
    more than d / least terms can be in the band, however large the corpus is."""
    # explode_outer: for explode, the optimiser adds a filter on the array's size, which computes it twice more
    counts = texts.select(F.explode_outer(terms(F.col("text"))).alias("term")).groupBy("term").count()
    band = counts.where(F.col("term").isNotNull() & F.col("count").between(max(2.0, least * n_docs), max(2.0, most * n_docs)))
    bits = [F.when(F.pmod(F.xxhash64("term", F.lit(i)), F.lit(rate)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, rate in enumerate(RATES)]
    mask = bits[0].cast("long")
    for b in bits[1:]:
        mask = mask.bitwiseOR(b.cast("long"))
    return band.select("term", mask.alias("mask"))  # no filter on the mask: it would be moved below the count, to each occurrence


def _bits(rates: list[int]) -> int:
    return sum(1 << i for i, r in enumerate(RATES) if r in rates)


def _any(members: Column, bits: int) -> Column:
    return F.filter(members, lambda m: m["mask"].bitwiseAND(F.lit(bits).cast("long")) != 0)


def fingerprint(sets: DataFrame, members: str, whole: str, out: str) -> DataFrame:
    """Adds out: the subsets' hashes, joined by '.': of subset i, the hash over its sorted terms, or '-' if it has
    none. A text without any (very short, or only words outside the band) has just the hash
    of the whole text, so that equal texts still agree.

    The members are thinned out to those of any subset of a rate first: the sparser subsets then look at few."""
    tiers = sorted(set(RATES))
    df = sets.withColumns({f"_{members}{r}": _any(F.col(members), _bits([r])) for r in tiers})

    def part(i: int) -> Column:
        chosen = _any(F.col(f"_{members}{RATES[i]}"), 1 << i)
        hashed = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.transform(chosen, lambda m: m["term"])))), 16, "0"), 1, 10)
        return F.when(F.exists(f"_{members}{RATES[i]}", lambda m: m["mask"].bitwiseAND(F.lit(1 << i).cast("long")) != 0), hashed).otherwise(F.lit("-"))

    joined = F.concat_ws(".", *[part(i) for i in range(len(RATES))])
    none = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col(whole))), 16, "0"))
    empty = F.lit(True)
    for r in tiers:
        empty = empty & (F.size(f"_{members}{r}") == 0)
    return df.withColumn(out, F.when(empty, none).otherwise(joined)).drop(*[f"_{members}{r}" for r in tiers])


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets that either fingerprint has terms of, the share whose hashes agree; 1 for
    equal fingerprints."""
    parts = F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b"))  # a lone '#' part leaves nulls beside it
    either = F.filter(parts, lambda p: ~((F.coalesce(p["a"], F.lit("-")) == "-") & (F.coalesce(p["b"], F.lit("-")) == "-")))
    same = F.size(F.filter(either, lambda p: p["a"] == p["b"])).cast("double")
    return F.when(a == b, F.lit(1.0)).when(F.size(either) == 0, F.lit(0.0)).otherwise(same / F.size(either))


def fingerprints(texts: DataFrame, lex: DataFrame, small: bool) -> DataFrame:
    """texts: keys (k, h), and the columns of texts to fingerprint, `text` and `edited`. Where
    texts are already dealt by the keys, the terms stay where they are: the lexicon comes to
    them, and the sets of terms are gathered without a shuffle. Of a text's terms those in the lexicon go on, and the first one
    whether or not it is, so that a text with none keeps its row."""
    def tagged(column: str, kind: int) -> Column:
        return F.transform(terms(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))

    keep = ["k", "h", "next_k", "next_h", "n_chars", "n_rows", "edited_sha256", "whole", "edited_whole"]
    rows = texts.withColumn("whole", F.xxhash64("text")).withColumn("edited_whole", F.xxhash64("edited"))
    rows = rows.select(*keep, F.posexplode_outer(F.concat(tagged("text", 0), tagged("edited", 1))).alias("at", "t"))
    rows = rows.select(*keep, F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("t.term", F.xxhash64("h", "k")).alias("term"), "t.kind")  # no null is a join's hot key
    found = rows.join(F.broadcast(lex) if small else lex, "term", "left").where("mask is not null or at = 0")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("mask").isNotNull() & (F.col("kind") == kind), F.struct("term", "mask"))))
    sets = found.groupBy("k", "h").agg(*[F.first(c).alias(c) for c in keep[2:]], of(0).alias("a"), of(1).alias("b"))
    sets = fingerprint(fingerprint(sets, "a", "whole", "fingerprint"), "b", "edited_whole", "edited_fingerprint")
    return sets.select("k", "h", "next_k", "next_h", "n_chars", "n_rows", "edited_sha256", "fingerprint", "edited_fingerprint")


def edited_fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text without its last floor(n/2) code points, then the first as many (or
    all) of the next document's, in descending doc_id, after the last the first. A document alone
    is its own next. Null text is empty text. Null ids come last in that order. Rows of one id are
    ordered by a hash of their texts; rows equal in id and text are one document in that order, and each gets its result. An empty table
    gives no rows. Other columns are ignored.

    Texts are shuffled once, by id (and half of them once more, to the document before), document
    numbers as three small columns. Document frequencies are summed within each task first."""
    no_id = F.lit(-(2**63)).cast("long")  # plain keys: null-safe ones would be dealt out again for the sets of terms
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = base.groupBy("k", "h").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("n_rows"))
    ids, n = numbered(ids, [F.col("k"), F.col("h")])
    ids = cut(ids, "ids")
    if ids.where("n_rows > 1").limit(1).count():  # else no row is repeated, and there is nothing to merge
        base = base.dropDuplicates(["k", "h"])
    after = ids.select(F.col("rn").alias("next_rn"), F.col("k").alias("next_k"), F.col("h").alias("next_h"))
    order = ids.withColumn("next_rn", F.pmod(F.col("rn") - 1, F.lit(max(n, 1)))).join(after, "next_rn").select("k", "h", "n_chars", "n_rows", "next_k", "next_h")
    order = cut(order, "order")
    to = order.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), "n_chars", "n_rows")
    given = base.join(to, ["k", "h"]).select(F.col("to_k").alias("_k"), F.col("to_h").alias("_h"), "half", "n_chars", "n_rows", F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.expr("substring(text, 1, half)").alias("given"))
    own = base.join(given, (base["k"] == given["_k"]) & (base["h"] == given["_h"]))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"), F.col("given"))
    texts = own.select("k", "h", "text", "next_k", "next_h", "n_rows", F.col("n_chars").cast("long").alias("n_chars"), edited.alias("edited"))
    texts = texts.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    lex = cut(lexicon(base.select("text"), n, least, most), "lexicon")
    marks = cut(fingerprints(texts, lex, lex.count() <= BROADCAST_TERMS), "fingerprints")
    nexts = marks.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("fingerprint").alias("_next"))
    out = marks.join(nexts, ["next_k", "next_h"]).withColumn("doc_id", F.nullif(F.col("k"), no_id))
    out = out.withColumn("row", F.explode(F.expr("sequence(1L, n_rows)")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
