"""Spelling variants against brute force and SQL."""

import collections
import random
import re
import zlib

import pytest

from evidora.llm import spelling


def brute(rows, least=5, shortest=6, every=199, times=5):
    """The contract, read plainly."""
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    return grouped(v, times)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def grouped(v, times=5):
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-v[x], x))
            form[w] = best if v[best] >= times * v[w] else None
    out = set()
    for w, n in v.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), v[f] if f else None))
    return out


def rows_of(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("every", [199, 3])
def test_odd(spark, odd, every):
    for least in (1, 5):
        got = rows_of(spelling.variants(spelling.words(odd, least, 3, every)))
        assert got == brute(given(odd), least, 3, every) and got


def test_query_by_brute_force(spark, sf_dir):
    assert rows_of(spelling.query(spark, sf_dir)) == brute(given(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert rows_of(spelling.query(spark, sf_dir)) == set(c.sql(spelling.ORACLE).fetchall())


def test_crc32_in_sql():
    import duckdb

    for text in ("0:a", "", "12:éàÿ", "x" * 300):
        assert duckdb.execute(f"SELECT {spelling.crc32_sql('x')} FROM (SELECT ? AS x)", [text]).fetchone()[0] == zlib.crc32(text.encode())


@pytest.mark.parametrize("shard_words, shard_chars, pass_bytes", [(1, 10, 1), (7, 1000, 300), (1000, 40, 5000)])
def test_shards_and_passes(spark, shard_words, shard_chars, pass_bytes):
    """Small alphabets, runs of one letter, prefixes of each other, and a word longer than a shard; many shards in many passes."""
    rng = random.Random(shard_words)
    v = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 5, 9, 30, 200, 2000]) for _ in range(60)}
    v |= {"a" * n: 5**n for n in range(1, 9)} | {"b" * 300: 4, "b" * 301: 40, "b" * 150 + "x" + "b" * 150: 7}
    df = spark.createDataFrame(list(v.items()), "word string, n long")
    assert rows_of(spelling.variants(df, 5, shard_words, shard_chars, pass_bytes)) == grouped(v)


def test_automaton():
    rng = random.Random(1)
    for _ in range(30):
        v = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(40)})
        trie = spelling.Trie.of(v, list(range(len(v))))
        for w in v + ["", "abab", "c"]:
            assert sorted(trie.near(w)) == [(x, i) for i, x in enumerate(v) if one_apart(w, x)]


def test_nothing(spark, nothing):
    assert spelling.variants(spelling.words(nothing)).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None), (2, ""), (3, "ab 12")], "doc_id long, text string")
    assert spelling.variants(spelling.words(nulls)).count() == 0


def test_hot_words_and_long_runs(spark):
    """Most rows have one word; a run is longer than a shard's characters."""
    long = "q" * 70_000
    rows = [(i, "hotword " * 300) for i in range(50)] + [(100 + i, f"hotwort {long}") for i in range(6)]
    got = {r["word"]: r for r in spelling.variants(spelling.words(spark.createDataFrame(rows, "doc_id long, text string"), every=0), shard_chars=1000).collect()}
    assert got["hotword"]["n"] == 15_000 and got["hotwort"]["root"] == "hotword" and got[long]["n"] == 6
