"""Edge cases of the library's operators."""

import os

import pytest
from pyspark.sql import functions as F

from evidora.functions.text import strip_markup, tokens, words
from evidora.operators import constraints, context, evaluate, ingest, relational, rerank, retrieve
from evidora.sources import files


@pytest.mark.parametrize("n, chunks", [(0, 1), (1, 1), (64, 1), (65, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_chunk_boundaries(spark, n, chunks):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    got = ingest.chunks(docs).orderBy("chunk_no").collect()
    assert len(got) == chunks and sum(r["n_tokens"] for r in got) == n + 64 * (chunks - 1)


def test_null_text(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert ingest.chunks(docs).first()["n_tokens"] == 0
    assert retrieve.postings(docs).count() == 0


def test_markup(spark):
    html = "<p>a<!-- x > y --><script>var t='</p>';</script><b>b</b>\n c</p>"
    assert spark.range(1).select(strip_markup(F.lit(html)).alias("x")).first()["x"] == "a b c"


def test_tokens(spark):
    r = spark.range(1).select(tokens(F.lit("Été, x-1 ÖL")).alias("t"), words(F.lit("  a b\n")).alias("w")).first()
    assert r["t"] == ["été", "x", "1", "öl"] and r["w"] == ["a", "b"]


def test_bm25_ties_and_unknown_terms(spark):
    docs = spark.createDataFrame([(2, "red fox"), (1, "red fox"), (3, "blue"), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red"), (8, "nothing")], "item_id long, text string")
    got = retrieve.bm25(docs, q).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(7, 1, 1), (7, 2, 2)]


def test_empty_store_fails_when_read(spark):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red")], "item_id long, text string")
    assert retrieve.guarded(retrieve.bm25(docs, q), docs, "the corpus").count() == 1
    none = docs.limit(0)
    run = retrieve.guarded(retrieve.bm25(none, q), none, "the corpus")
    with pytest.raises(Exception, match="the corpus is empty"):
        run.collect()


@pytest.mark.parametrize("name", ["rerank_tiebreak", "ctx_render"])
def test_no_job_runs_before_the_action(spark, sf_dir, name):
    from evidora.registry import QUERIES

    QUERIES[name](spark, sf_dir)  # tables' schemas may be read
    group = f"lazy-{name}"
    spark.sparkContext.setJobGroup(group, name)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    QUERIES[name](spark, sf_dir)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3  # the schemas of three tables


def test_bm25_in_blocks(spark, sf_dir):
    docs, q = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda n: sorted(map(tuple, retrieve.bm25(docs, q, 7, block=n).collect()))
    assert rows(256) == rows(11)


def test_modes(spark, tmp_path):
    run = spark.createDataFrame([(1, 2, 1)], "query_id long, doc_id long, rank long")
    at = str(tmp_path / "snapshot")
    assert files.retrieved(lambda: run, at, spark, "live").count() == 1
    assert files.retrieved(lambda: 1 / 0, at, spark).collect() == run.collect()
    for path, mode in ((None, "snapshot"), (at, "other")):
        with pytest.raises(ValueError):
            files.retrieved(lambda: run, path, spark, mode)


def test_chunk_store_and_dictionaries(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c " * 400) for i in range(5)], "doc_id long, text string")
    files.write_chunks(ingest.chunks(docs), str(tmp_path / "chunks"), 4)
    assert sorted(map(tuple, files.read_chunks(spark, str(tmp_path / "chunks")).collect())) == sorted(map(tuple, ingest.chunks(docs).collect()))
    (tmp_path / "good.tsv").write_text("heart\tHerz\nhand\tHand\n")
    assert files.read_pairs(spark, str(tmp_path / "good.tsv")).count() == 2
    (tmp_path / "bad.tsv").write_text("heart\tHerz\nhand\n")
    with pytest.raises(Exception):
        files.read_pairs(spark, str(tmp_path / "bad.tsv")).collect()


def test_knn_is_exact_over_blocks(spark):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieve.knn(df, df.where("vec_id % 20 = 0"), 3, block=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 6)
        s[q] = -2
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-s, kind="stable")[:3])


def test_constant_leg_scales_to_one(spark):
    legs = spark.createDataFrame([(1, 1, "bm25", 1, 2.0), (1, 2, "bm25", 2, 2.0)], "query_id long, doc_id long, leg string, rank long, score double")
    assert {r["score"] for r in retrieve.fuse_weighted(legs, {"bm25": 0.5}).collect()} == {0.5}


def test_landmark_floor(spark):
    run = spark.createDataFrame([(1, i, 1.0 - i / 10, i == 6, i) for i in range(1, 8)], "query_id long, doc_id long, rel double, landmark boolean, rank long")
    got = {r["doc_id"]: r["rank"] for r in rerank.landmark_floor(run, 2, 0.1).collect()}
    assert got[6] == 3 and got[3] == 4 and got[7] == 7
    assert {r["doc_id"]: r["rank"] for r in rerank.landmark_floor(run, 2, 0.9).collect()}[6] == 6


def test_context_budget_and_sources(spark):
    run = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, doc_id long, rank long")
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "t"), (3, "c d", "s"), (4, "e f", "s"), (5, "g h", "u")], "doc_id long, text string, source string")
    got = context.assemble(run, docs, 2, 4).orderBy("s_no").collect()
    assert [(r["doc_id"], r["cite"]) for r in got] == [(1, "[S1]"), (3, "[S2]")]


def test_minhash_classes_and_components(spark, sf_dir):
    base = [f"w{i}" for i in range(60)]
    edited = lambda at, by: " ".join(base[:at] + [by] + base[at + 1 :])
    odd = [(900_001, " ".join(base)), (900_002, " ".join(base)), (900_003, edited(30, "x")), (900_004, edited(5, "y")), (900_005, ""), (900_006, None)]
    odd += [(900_007, "one two"), (900_008, "one two"), (900_009, "One two!"), (900_010, "a b c d e"), (900_011, "A b, c d e."), (None, "a b c d e"), (None, "no id at all, but words")]
    # two large groups of near copies that share buckets, but no link
    long = [f"v{i}" for i in range(200)]
    other = long[:90] + [f"u{i}" for i in range(24)] + long[114:]
    odd += [(901_000 + i, " ".join(long[: 8 * i] + ["z"] + long[8 * i + 1 :])) for i in range(10)] + [(902_000 + i, " ".join(other[: 8 * i] + ["z"] + other[8 * i + 1 :])) for i in range(10)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"] or "", r["w"] or []) for r in docs.select("doc_id", "text", tokens(F.col("text")).alias("w")).collect()]
    first, sets = {}, {}
    for i, t, w in rows:
        first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
        sets[t] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    texts = list(sets)
    root = {t: t for t in texts}

    def of(t):
        while root[t] != t:
            t = root[t]
        return t

    for n, t in enumerate(texts):
        for u in texts[:n]:
            both = len(sets[t] & sets[u])
            if both and 5 * both >= 4 * (len(sets[t]) + len(sets[u]) - both):
                root[of(t)] = of(u)
    least = {}
    for t in texts:
        least[of(t)] = min((x for x in (least.get(of(t)), first[t]) if x is not None), default=None)
    key = lambda p: tuple(-1 if x is None else x for x in p)
    got = sorted((tuple(r) for r in context.dedup_minhash(docs).collect()), key=key)
    assert got == sorted(((i, first[t], least[of(t)]) for i, t, _ in rows), key=key)
    found = {r[0]: r[2] for r in got}
    assert {found[x] for x in (900_001, 900_003, 900_004)} == {900_001} and found[900_011] == 900_010
    assert {found[901_000 + i] for i in range(10)} == {901_000} and {found[902_000 + i] for i in range(10)} == {902_000}


def test_minhash_of_nothing(spark):
    assert context.dedup_minhash(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_minhash_writes_only_compared_texts(spark, monkeypatch):
    """Shingles are written down for texts that share a band with another, not for all; copies and short texts keep their rows."""
    written = {}

    def kept(df, name, cut=context.cut):
        written[name] = out = cut(df, name)
        return out

    monkeypatch.setattr(context, "cut", kept)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(50)] + [(60, " ".join(f"w7x{j}" for j in range(39))), (61, "too short"), (62, "too short"), (63, None), (None, "")]
    got = {tuple(r) for r in context.dedup_minhash(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {(i, i, i) for i in range(50)} | {(60, 60, 7), (61, 61, 61), (62, 61, 61), (63, 63, 63), (None, 63, 63)}
    assert written["sets"].count() == 2 and not {"s", "text"} & set(written["classes"].columns) and written["classes"].count() == 53


def test_citation_checks(spark):
    a = spark.createDataFrame([(1, 2, "x [S1] y [S0] z [S99]"), (2, 0, "none")], "query_id long, n_sources long, answer string")
    assert {r["query_id"]: (r["n_cited"], r["n_bad"]) for r in constraints.out_of_range(a).collect()} == {1: (3, 2), 2: (0, 0)}
    assert {r["query_id"]: r["answer"] for r in constraints.repair(a).collect()} == {1: "x [S1] y z [S2]", 2: "none"}
    assert {r["query_id"]: (r["unlisted"], r["uncited"]) for r in constraints.reference_balance(a).collect()} == {1: ("0,99", "2"), 2: ("", "")}


def test_tristate_year_equal_is_no_refusal(spark):
    ev = spark.createDataFrame([(1, 10, 2010), (2, 11, 2012), (2, 12, 2009), (3, 13, 2011)], "query_id long, doc_id long, year long")
    asked = spark.createDataFrame([(1, 2010), (2, 2010), (3, 2010), (4, 2010)], "query_id long, asked_year long")
    assert {r["query_id"]: r["status"] for r in constraints.tristate(ev, asked).collect()} == {1: "normal", 2: "partial", 3: "refused", 4: "refused"}


def test_target_absent_from_run(spark):
    q = spark.createDataFrame([(0,), (3,)], "item_id long")
    qrels = spark.createDataFrame([(0, 5)], "query_id long, doc_id long")
    run = spark.createDataFrame([(0, 6, 1)], "query_id long, doc_id long, rank long")
    best = evaluate.best_ranks(q, qrels, run)
    r = evaluate.by_tier(best).first()
    assert (r["n_queries"], r["n_without_target"], r["r10"], r["mrr"]) == (2, 1, 0.0, 0.0)


def test_asof_takes_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "u long, t long")
    right = spark.createDataFrame([(1, 5, 7.0), (1, 2, 3.0)], "u long, t long, v double")
    assert sorted((r["u"], r["t"], r["v"]) for r in relational.asof(left, right, "u", "t", "v").collect() if r["v"]) == [(1, 5, 7.0)]


def test_stores(spark, tmp_path):
    p = str(tmp_path / "post")
    post = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("a", 3, 1)], "term string, doc_id long, tf long")
    files.write_postings(post, p, 8)
    assert sorted(r["doc_id"] for r in files.read_postings(spark, p, ["a"], 8).collect()) == [1, 3]
    empty = str(tmp_path / "empty")
    post.limit(0).write.parquet(empty)
    with pytest.raises(ValueError, match="empty"):
        files.open_index(spark, empty)
    (tmp_path / "x.jsonl").write_text('{"chunk_id": "c", "doc_id": 1, "text": "t"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl")).first()["doc_id"] == 1
    files.append_calls(post, str(tmp_path / "calls"))
    files.append_calls(post, str(tmp_path / "calls"))
    assert spark.read.parquet(str(tmp_path / "calls")).count() == 6
    (tmp_path / "a.xml").write_text("<set><article><article_id>P1</article_id><title>T</title><sec><label>A</label><p>x</p></sec><sec><label>B</label><p>y</p></sec></article></set>")
    assert [s["label"] for s in ingest.articles(spark, str(tmp_path / "a.xml")).first()["sec"]] == ["A", "B"]


def test_resolvers(tmp_path, monkeypatch):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    monkeypatch.delenv("EVIDORA_ROOT", raising=False)
    with pytest.raises(RuntimeError):
        files.resolve_root(str(deep), markers=("no-such-marker",))
    (tmp_path / "scripts").mkdir()
    (tmp_path / "frozen-copy").mkdir()
    assert files.resolve_root(str(deep), fallback=str(tmp_path / "frozen-copy")) == str(tmp_path / "frozen-copy")  # one marker isn't enough
    (tmp_path / "requirements.txt").write_text("")
    assert files.resolve_root(str(deep)) == str(tmp_path)
    with pytest.raises(RuntimeError):
        files.resolve_root(str(deep), depth=2)
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("EVIDORA_ROOT", "~/a")
    assert files.resolve_root() == str(tmp_path / "a")
    monkeypatch.setenv("EVIDORA_ROOT", str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        files.resolve_root(str(deep))
    fresh, frozen = tmp_path / "fresh", tmp_path / "frozen"
    frozen.mkdir()
    (frozen / "f").write_text("x")
    assert files.evidence_path("f", str(fresh), str(frozen)) == str(frozen / "f")
    assert files.evidence_path("g", str(fresh), str(frozen)) == os.path.join(str(fresh), "g")


@pytest.mark.parametrize("k", [1, 3])
def test_best_run_never_downgrades(spark, k):
    runs = spark.createDataFrame([("s", 1, 1, 10), ("s", 2, 0, 99 * k)], "suite string, run_id long, n_live long, n_pass long")
    assert evaluate.best_run(runs).first()["run_id"] == 1


def test_term_maps_shuffle_texts_not_terms(spark, tmp_path):
    """Counts go over all rows of an id, and what is shuffled is a row for each text."""
    from evidora.registry import QUERIES

    rows = [(1, "a a a B"), (1, "A a b"), (2, None), (None, "c c c c c"), (3, "d d d d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["fn_map"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(1, "a", 5), (None, "c", 5)} and out.count() == 2
    assert "Exchange" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "k#" not in plan[plan.rindex("Exchange") :]
