"""Spelling variants: words at distance one, found by each word's Levenshtein automaton in broadcast trie shards."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import built, cut

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shard takes so many words, or characters of them; a longer word is a shard of its own.
SHARD_WORDS, SHARD_CHARS = 1 << 16, 1 << 22
#: Bytes of shards that are broadcast at once; a pass over the words meets these.
PASS_BYTES = 1 << 25
SHARD = "labels string, first binary, ends binary, counts binary, size long"


def words(docs: DataFrame, least: int = 5, shortest: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of whole texts, lower-cased in A-Z, of `shortest` code points or more and with `least` occurrences or more. One in `every` of a
    document's runs, by the CRC of `<id>:<run>`, has lost a letter first (0: none has). Counted within each task before the shuffle. Null texts have no words; rows
    without an id have an empty one."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))).alias("run"))
    word = F.col("run")
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Trie:
    """Sorted words as a trie without pointers: nodes in breadth-first order, so that a node's children are the nodes first[k] up to first[k + 1], in the order of their
    letters. labels has each node's letter (the root's is a blank), ends the number of the word that ends there (none: -1), counts those of the words."""

    def __init__(self, labels: str, first: array, ends: array, counts: array):
        self.labels, self.first, self.ends, self.counts = labels, first, ends, counts

    @classmethod
    def of(cls, sorted_words: list[str], counts: list[int]) -> Trie:
        labels, first, ends = [" "], array("i"), array("i")
        level = [(0, len(sorted_words))]
        depth, nodes = 0, 1
        while level:
            below = []
            for low, high in level:
                ends.append(-1)
                if low < high and len(sorted_words[low]) == depth:
                    ends[-1] = low
                    low += 1
                first.append(nodes)
                while low < high:
                    letter, start = sorted_words[low][depth], low
                    low += 1
                    while low < high and sorted_words[low][depth] == letter:
                        low += 1
                    labels.append(letter)
                    below.append((start, low))
                    nodes += 1
            level, depth = below, depth + 1
        first.append(nodes)
        return cls("".join(labels), first, ends, array("q", counts))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words at distance one, and their counts: the automaton of word runs through the trie depth-first. It stands at a node with the letters before place i
        read and no edit made, or is past its one edit and has but to read the rest. Edits that give the same word (a letter doubled or taken out of a run of it) are made
        at the end of the run only."""
        labels, first, ends, counts = self.labels, self.first, self.ends, self.counts
        find, size, node = labels.find, len(word), 0
        for i in range(size + 1):
            low, high = first[node], first[node + 1]
            here = word[i] if i < size else ""
            if here and here != word[i + 1 : i + 2]:
                end = self._rest(word, i + 1, node)
                if end >= 0:
                    yield word[:i] + word[i + 1 :], counts[end]
            for child in range(low, high):
                letter = labels[child]
                if letter != here:
                    end = self._rest(word, i, child)
                    if end >= 0:
                        yield word[:i] + letter + word[i:], counts[end]
                    if here:
                        end = self._rest(word, i + 1, child)
                        if end >= 0:
                            yield word[:i] + letter + word[i + 1 :], counts[end]
            if not here:
                return
            node = find(here, low, high)
            if node < 0:
                return

    def _rest(self, word: str, i: int, node: int) -> int:
        """The number of the word that reading word[i:] from node ends at, or -1."""
        labels, first = self.labels, self.first
        for i in range(i, len(word)):  # noqa: B020
            node = labels.find(word[i], first[node], first[node + 1])
            if node < 0:
                return -1
        return self.ends[node]


def _shards(most_words: int, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of() -> pa.RecordBatch:
            t = Trie.of(held, counts)
            parts = [t.first.tobytes(), t.ends.tobytes(), t.counts.tobytes()]
            size = len(t.labels.encode()) + sum(map(len, parts))
            return pa.RecordBatch.from_arrays([pa.array([t.labels]), *[pa.array([p], pa.binary()) for p in parts], pa.array([size], pa.int64())], names=["labels", "first", "ends", "counts", "size"])

        held, counts, chars = [], [], 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) == most_words or chars + len(word) > most_chars):
                    yield of()
                    held, counts, chars = [], [], 0
                held.append(word)
                counts.append(n)
                chars += len(word)
        if held:
            yield of()

    return run


def _loaded(row) -> Trie:
    ints = lambda kind, data: array(kind, bytes(data))
    return Trie(row["labels"], ints("i", row["first"]), ints("i", row["ends"]), ints("q", row["counts"]))


def _meet(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = shared.value
        for batch in batches:
            given = batch.column(0).to_pylist()
            n_near, best, best_n = np.zeros(len(given), np.int64), [None] * len(given), np.zeros(len(given), np.int64)
            for trie in tries:
                for k, word in enumerate(given):
                    for other, n in trie.near(word):
                        n_near[k] += 1
                        if n > best_n[k] or n == best_n[k] and other < best[k]:
                            best[k], best_n[k] = other, n
            keep = np.flatnonzero(n_near)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(n_near[keep]), pa.array([best[k] for k in keep], pa.string()), pa.array(best_n[keep])], names=["word", "n_near", "best", "best_n"])

    return run


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, n_near, best, best_n: for each word of vocabulary (word, n; distinct) that has any, the number of words at distance one, and the one of them of
    largest n (then smallest).

    The words are range-sorted, and each task turns its range into trie shards of bounded size. Shards are broadcast, up to pass_bytes of them at once (a shard at
    least), and all words meet them; however large the vocabulary is, no more than that is on a machine or passes through the driver at a time. What a
    pass finds is written down, one row for each word, so the passes' results are added up without any pair of words being shuffled."""
    spark = vocabulary.sparkSession
    vocabulary = cut(vocabulary.select("word", "n"), "vocabulary")
    parts = vocabulary.count() // 8192 + 1
    ranged = vocabulary.repartitionByRange(parts // 8 + 1, "word").sortWithinPartitions("word")
    shards = cut(ranged.mapInArrow(_shards(shard_words, shard_chars), SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    passes: list[list[int]] = []
    room = 0
    for r in shards.select("shard", "size").orderBy("shard").toLocalIterator():  # a few bytes for each 65,536 words
        if not passes or r["size"] > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(r["shard"])
        room -= r["size"]
    found = []
    for some in passes:
        shared = spark.sparkContext.broadcast([_loaded(r) for r in shards.where(F.col("shard").between(some[0], some[-1])).collect()])
        found.append(cut(vocabulary.select("word").repartition(parts).mapInArrow(_meet(shared), "word string, n_near long, best string, best_n long"), "near"))
        shared.destroy()
    if not found:
        return vocabulary.select("word", F.lit(0).cast("long").alias("n_near"), F.col("word").alias("best"), F.col("n").alias("best_n")).limit(0)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", "top.best", (-F.col("top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead in the end. Each round follows twice as many steps as the one before; a form has at least five times its
    word's occurrences, so chains are short. Written down each round."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = at.join(built(step), F.col("root") == F.col("_word"), "left")
        new = cut(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def variants(vocabulary: DataFrame, times: int = 5, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """vocabulary (word, n) with its groups: form (the near word of largest n, ties by code points, where that is at least `times` as frequent; else null), root (where forms lead
    from a word; itself without any), n, n_near (near words), form_n (the form's n or null).

    Words are distinct and not null; near are two that differ by exactly one inserted, deleted or replaced code point. An empty vocabulary gives no rows."""
    vocabulary = cut(vocabulary, "words")
    near = cut(neighbours(vocabulary, shard_words, shard_chars, pass_bytes).withColumnRenamed("word", "_of"), "neighbours")
    joined = vocabulary.join(built(near), F.col("word") == F.col("_of"), "left")
    has = F.col("best_n") >= times * F.col("n")
    named = cut(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "named")
    to = roots(named.where("form is not null")).select(F.col("word").alias("_of"), F.col("root").alias("_root"))
    out = named.join(built(to), F.col("word") == F.col("_of"), "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)  # noqa: PLW2901
        out.append(i)
    return out


def crc32_sql(text: str) -> str:
    """DuckDB has no CRC: the unsigned CRC-32 of a text's UTF-8 bytes as an expression."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


#: Words whose deletions of a letter are equal, or equal the other word, are near.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{6,}}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM d),
x AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
o AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS short FROM g),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.short UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.short),
q AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM q WHERE k = 1) USING (word)),
c(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, max_by(root, depth) AS root FROM c GROUP BY word) e USING (word)
"""
