"""The three-way merge against brute force and SQL."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from evidora.llm import merging

SCHEMA = "doc_id long, lang string, source string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def branch(name, i, lang, source, text):
    """State of a row in a branch, read plainly from the contract: (row dropped, {part: new state}, added row or None)."""
    code = lambda what: zlib.crc32(f"{name}:{'' if i is None else i}:{what}".encode()) % 17
    parts, row, added = {}, code("row"), None
    if row in (3, 4) and i is not None:
        added = ((-1 if name == "L" else -5) - i, lang, source, "!" if row == 3 else "?")
    for what, old in (("lang", lang), ("source", source)):
        new = {0: "", 1: old + "!", 2: old + "?"}.get(code(what), old)
        if new != old:
            parts["column", what] = new
    for k, line in enumerate(text.split("\n")):
        c = code(k)
        if c == 0:
            parts["line", k] = None
        elif c in (1, 2):
            parts["line", k] = line + " !?"[c]
        elif c in (3, 4):
            parts["gap", k] = " !?"[c - 2]
    return row == 0, parts, added


def brute(rows):
    out, added = [], {"L": collections.defaultdict(set), "R": collections.defaultdict(set)}
    ids = {i for i, *_ in rows if i is not None}
    for row in rows:
        for name in "LR":
            new = branch(name, row[0], *(x or "" for x in row[1:]))[2]
            if new:
                added[name][new[0]].add(new[1:])
    clashes = {i: max(len(added[n][i]) if i in added[n] else 0 for n in "LR") for i in {*added["L"], *added["R"]}}
    for i, *rest in rows:
        lang, source, text = (x or "" for x in rest)
        (l_gone, l, _), (r_gone, r, _) = branch("L", i, lang, source, text), branch("R", i, lang, source, text)
        clean = ee = ed = ii = 0
        state = None
        if l_gone or r_gone:
            if l_gone and not r_gone and r or r_gone and not l_gone and l:
                ed = 1
                state = None if l_gone else l
            else:
                clean = 1
        else:
            state = dict(l)
            for part in {*l, *r}:
                if part in l and part in r and l[part] != r[part]:
                    if part[0] == "gap":
                        ii += 1
                    elif None in (l[part], r[part]):
                        ed += 1
                    else:
                        ee += 1
                else:
                    clean += 1
                    state[part] = l[part] if part in l else r[part]
        ii += clashes.get(i, 0)
        if state is None:
            out.append((i, None, None, None, clean, ee, ed, ii))
            continue
        lines = []
        for k, line in enumerate(text.split("\n")):
            line = state.get(("line", k), line)
            lines += [line] if line is not None else []
            lines += [state["gap", k]] if ("gap", k) in state else []
        out.append((i, state.get(("column", "lang"), lang), state.get(("column", "source"), source), sha("\n".join(lines)), clean, ee, ed, ii))
    for i in {*added["L"], *added["R"]} - ids:
        a, b = (sorted(added[n].get(i, ())) for n in "LR")
        for k in range(max(len(a), len(b))):
            x, y = (v[k] if k < len(v) else None for v in (a, b))
            fight = x is not None and y is not None and x != y
            lang, source, text = x or y
            out.append((i, lang, source, sha(text), int(not fight), 0, 0, int(fight)))
    return collections.Counter(out)


def digests(out):
    out = out.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
    return collections.Counter(tuple(r) for r in out.collect())


def given(docs):
    return [tuple(r) for r in docs.select("doc_id", "lang", "source", "text").collect()]


def test_query_by_brute_force(spark, sf_dir):
    got = collections.Counter(tuple(r) for r in merging.query(spark, sf_dir).collect())
    assert got == brute(given(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert collections.Counter(tuple(r) for r in merging.query(spark, sf_dir).collect()) == collections.Counter(c.sql(merging.ORACLE).fetchall())


def test_odd(spark, odd, nothing):
    assert digests(merging.merge_branches(odd)) == brute(given(odd))
    assert merging.merge_branches(nothing).count() == 0


def many():
    """Dense ids (so that both branches add the same), ids below zero (which added rows meet), short lines, all kinds of ends."""
    rows = [(i, ["en", "", None, "de"][i % 4], ["a", None][i % 2], ["a\nb\n\nc", "", None, "x\n", "\n\n", "one line"][i % 6]) for i in range(-40, 300)]
    rows += [(i, f"l{k}", None, f"t{k}\n" * k) for i in (7, 8, 9, 200) for k in range(6)] + [(None, None, None, f"n{k % 5}\nm") for k in range(60)]
    rows += [(5000, "en", "s", "same\nrows")] * 40
    return rows


@pytest.mark.parametrize("most", [1, 3000, 1 << 23])
def test_chunks(spark, most):
    """However small the tables are that DuckDB gets, also where an id goes on through many of them."""
    rows = many()
    tagged = merging.tagged(spark.createDataFrame(rows, SCHEMA))
    out = merging.merged(tagged, merging.edits(tagged), most)
    out = out.select(F.col("id").alias("doc_id"), F.col("cols")[0].alias("lang"), F.col("cols")[1].alias("source"), "text", *merging._COUNTS)
    assert digests(out) == brute(rows)


def test_every_kind_of_conflict(spark):
    got = brute(many())
    assert all(any(r[k] for r in got) for k in range(4, 8)) and any(r[3] is None and r[6] for r in got) and any(r[3] and r[6] == 1 and not r[4] for r in got)


def test_a_long_document(spark):
    rows = [(3, "en", "s", "\n".join(f"line {k}" for k in range(60_000))), (4, "en", "s", "x" * 3_000_000), (5, None, None, "\n" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(merging.merge_branches(df)) == brute(rows)


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "z", "q")], "key long, body string, tag int, id string, side string")
    out = merging.merge_branches(df, ["tag", "side"], "key", "body")
    assert out.columns == ["key", "tag", "side", "body", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"] and out.count() >= 1
    assert merging.merge_branches(df, [], "key", "body").columns[:2] == ["key", "body"]


def test_changes_of_ones_own(spark):
    """The operator takes any branches, not those of the query alone."""
    base = spark.createDataFrame([(1, 11, ["en"], "a\nb\nc"), (2, 12, ["de"], "x")], "id long, tag long, cols array<string>, text string")
    changes = [(1, 1, 11, "line", 0, "A", None), (2, 1, 11, "line", 0, "AA", None), (2, 1, 11, "line", 2, None, None), (1, 1, 11, "gap", 1, "new", None), (2, 1, 11, "column", 0, "fr", None)]
    changes += [(1, 2, 12, "row", 0, None, None), (2, 2, 12, "line", 0, "y", None), (1, 9, 1, "added", 0, "t", ["en"]), (2, 9, 2, "added", 0, "t", ["en"])]
    changes += [(1, 77, 3, "line", 0, "no such row", None)]
    got = {tuple(map(str, r)) for r in merging.merged(base, spark.createDataFrame(changes, merging.CHANGES)).collect()}
    assert got == {("1", "['fr']", "A\nb\nnew", "3", "1", "0", "0"), ("2", "None", "None", "0", "0", "1", "0"), ("9", "['en']", "t", "1", "0", "0", "0")}
