"""The ten operators against brute force and exact round trips, on odd and on real small tables."""

import collections
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from brute import WORD, all_ids, check_pieces, components_of, kept_lines, near, pairs, removed, water
from pyspark.sql import functions as F

from evidora.llm import bagminhash, common, embeddings, fingerprints, graph, hashing, lines, mixing, neardup, packing, sharding, substrings, tokens, toxicity
from evidora.llm import pairs as similar


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- 1 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("window, k", [(50, 16), (8, 3)])
def test_substrings(spark, odd, sf_dir, window, k):
    for df in (odd, documents(spark, sf_dir)):
        got = [(r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df, window, k).collect()]
        key = lambda r: (str(r[0]), *r[1:])
        assert sorted(got, key=key) == sorted(removed(pairs(df), window), key=key)


@pytest.mark.parametrize("window, k", [(50, 16), (8, 3)])
def test_substrings_that_repeat_in_the_first_document(spark, window, k):
    """A passage of document 3 in blocks that document 5 (in one row or in two) has more than once."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
        passage = prose(70)
        s = " ".join([prose(100), passage, prose(100)])
        for rest in ([(5, f"{s} {prose(60)} {s}")], [(5, f"{prose(60)} {s}"), (5, f"{s} {prose(60)}"), (5, f"{s} {prose(60)}")]):
            rows = [(3, f"{prose(90)} {passage} {prose(90)}"), *rest, (7, s)]
            got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, k).collect()
            assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(removed(rows, window))


def test_substrings_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


def test_factors(spark, sf_dir):
    """Each factor is the same words in the earlier document that it names, goes on as far as it can there, and together they cover what is removed."""
    df = documents(spark, sf_dir)
    words = {(i, zlib.crc32((t or "").encode())): WORD.findall(t or "") for i, t in pairs(df)}
    of = {i: w for (i, _), w in words.items()}
    some = 0
    for r in substrings.remove_repeats(df).collect():
        mine, gone, before = of[r["id"]], set(), None
        for f in r["factors"]:
            start, n, there = f["start"], f["length"], words[f["ref_id"], f["ref_tag"]]
            assert n >= 50 and f["ref_id"] < r["id"] and mine[start : start + n] == there[f["ref_start"] : f["ref_start"] + n]
            assert before is None or start > before["start"] and start > before["start"] + before["length"] - 50
            if before and start == before["start"] + before["length"] - 49:  # it goes on elsewhere, or would be the same factor
                assert (before["ref_id"], before["ref_tag"], before["ref_start"] - before["start"]) != (f["ref_id"], f["ref_tag"], f["ref_start"] - start)
            gone.update(range(start, start + n))
            before, some = f, some + 1
        spans = [i for s in r["spans"] for i in range(s["start"], s["end"])]
        assert len(gone) == r["n_removed"] and spans == sorted(gone)
    assert some > 10


def test_parse():
    """Windows 0..9 and 10..12 follow in one place of document 1, 13 in another, 20 alone."""
    known = np.array([[0, 9, 1, 7, 100], [13, 13, 1, 7, 300], [10, 12, 1, 7, 110], [20, 20, 2, 8, 5]]).T
    f = substrings.parse(*known, 50)
    assert [x.tolist() for x in f] == [[0, 13, 20], [62, 50, 50], [1, 1, 2], [7, 7, 8], [100, 300, 5]]
    assert substrings.covered(f, 80)[1].tolist() == [[0, 70]]


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_patterns_that_polynomials_modulo_a_power_of_two_take_for_equal(spark):
    """Words, lines, and runs of words that are Thue-Morse sequences, and their complements."""
    one, two = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    rest = [f"w{i}" for i in range(60)]
    cases = [[rest[:30] + [x] + rest[30:] for x in (one, two)], [thue_morse(1024, *x) for x in (("yes", "no"), ("no", "yes"))]]
    for some in cases:
        rows = [(i, " ".join(w)) for i, w in enumerate(some)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = substrings.remove_repeats(df).collect()
        assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(removed(rows, 50))
        expected = near(rows)
        assert {r["doc_id"]: r["component_id"] for r in neardup.near_classes(df).collect()} == {i: c for (i, _), c in expected.items()}
    keys = hashing.string_hashes([one, two])
    assert keys[0] != keys[1]
    sequences = [hashing.string_hashes(thue_morse(4096, *x)) for x in ("ab", "ba")]
    for n in (5, 16, 50, 1024, 4096):
        a, b = ({hashing.runs(h, n)[0], hashing.Runs(h).hashes(np.array([0]), np.array([n]))[0]} for h in sequences)
        assert not a & b


def test_hashes_dont_depend_on_place(monkeypatch):
    text = b"x  one two\tthree\n four one two\x0bthree " + "é ü".encode()
    data = np.frombuffer(text, np.uint8)
    h = hashing.word_hashes(data)
    assert h.tolist() == hashing.string_hashes(text.split()).tolist() and h[1:4].tolist() == h[5:8].tolist()
    r = hashing.Runs(h)
    assert r.hashes(np.array([1]), np.array([4])) == r.hashes(np.array([5]), np.array([8])) != r.hashes(np.array([2]), np.array([5]))
    assert hashing.runs(h, 3)[1] == hashing.runs(h, 3)[5]
    whole = [(a.tolist(), b.tolist()) for a, b in hashing.many_words([data, data[:0], data])]
    for chunk in (1, 5, 13):  # texts longer than a chunk
        monkeypatch.setattr(hashing, "CHUNK", chunk)
        assert hashing.word_hashes(data).tolist() == h.tolist()
        assert sum((a.tolist() for a, _ in hashing.many_words([data, data[:0], data])), []) == whole[0][0]


# ---- 2 and 5 -------------------------------------------------------------------------------


def test_matrices_round_trip(spark, odd, sf_dir):
    for df, small in ((odd, 100_000), (documents(spark, sf_dir), 20_000)):
        found = collections.defaultdict(list)
        for r in packing.pack_matrices(df, buffer=small).collect():
            ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u2")
            assert len(ids) == len(places) == 1024 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 0).all()
            for i, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                assert (places[a:b] == np.arange(b - a)).all()
                found[i, start].append(ids[a:b].tobytes())
        expected = collections.defaultdict(list)
        for i, ids in all_ids(pairs(df)):
            for _, start, n in tokens.cuts(len(ids)):
                expected[i, start].append(ids[start : start + n].tobytes())
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_special_tokens_are_one_id(spark):
    """As the tokenizers library reads the file: its added tokens are single ids wherever they stand."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "<|EndOfText|> \u00e9 <|endoftext|>\n" * 400, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 50256 in all_ids([(0, texts[0])])[0][1] and all((tokens.token_ids(t) == x).all() for (_, x), t in zip(all_ids(list(enumerate(texts))), texts))
    check_pieces(df, packing.pack_pieces(df).collect())


def test_pieces(spark, odd, sf_dir):
    for df in (odd, documents(spark, sf_dir).repartition(13)):
        check_pieces(df, packing.pack_pieces(df, fan_in=3).collect(), 0.08)  # thirteen partitions of 15 documents each


def test_packing_nothing(nothing):
    assert packing.pack_matrices(nothing).count() == 0 and packing.pack_pieces(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.integers(1, 70))
    sizes = rng.integers(1, most + 1, int(rng.integers(0, 300)))
    bins, offsets, n = packing.best_fit_decreasing(sizes, most)
    room = []  # brute force: the bin of the least room that fits, newest first among equals
    for size in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in room if r >= size]
        if fits and size < most:
            room.remove(min(fits))
            room.append(min(fits) - size)
        else:
            room.append(most - size)
    fill = np.bincount(bins, sizes, minlength=n) if len(sizes) else np.zeros(0)
    assert sorted(most - fill) == sorted(room)
    for b in range(n):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert (offsets[at] == np.cumsum(sizes[at]) - sizes[at]).all()


def test_cuts():
    assert list(tokens.cuts(1024)) == [(0, 0, 1024)] and list(tokens.cuts(1025)) == [(0, 0, 1), (1, 1, 1024)]
    assert list(tokens.cuts(2048)) == [(0, 0, 1024), (1, 1024, 1024)]


# ---- 3 -------------------------------------------------------------------------------------


def test_mix(spark, odd, sf_dir):
    for df in (odd, documents(spark, sf_dir)):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        sizes, taken = collections.Counter(), collections.Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        expected = water(sizes)
        for r in got:
            assert abs(r["target"] - expected[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
        assert all(abs(taken[s] - expected[s]) <= 0.5 + 1e-6 for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_mixed_documents(spark, odd):
    """Every word that the plan takes is written: by id, and over all rows, alike or not."""
    alike = odd.unionByName(odd.where("doc_id in (1, 3, 10, 16)")).unionByName(odd.where("doc_id = 8").withColumn("text", F.reverse("text")))
    for df in (odd, alike):
        plan = collections.Counter()
        for r in mixing.mix(df).collect():
            plan[r["doc_id"]] += r["taken"]
        out = mixing.mixed_documents(df)
        assert out.columns == df.columns
        words = collections.Counter()
        texts = collections.defaultdict(list)
        for i, t in pairs(df):
            texts[i].append(t or "")
        for i, t in pairs(out):
            words[i] += len(WORD.findall(t or ""))
            assert any(x.startswith(t or "") for x in texts[i])
        assert {i: n for i, n in words.items() if n} == {i: n for i, n in plan.items() if n}


def test_mix_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# ---- 4 -------------------------------------------------------------------------------------


def test_lines(spark, odd):
    base = "a line of some length that is here to be nearly copied, number "
    near = spark.createDataFrame([(i, f"{base}{i}\nown line {i * 7919} {'abcdefgh'[i % 8] * 9}\n" + base) for i in range(12)], "doc_id long, text string")
    for df in (odd, near):
        out = lines.dedup_lines(df)
        assert out.columns[: len(df.columns)] == df.columns
        expected = kept_lines(pairs(df))
        before = sorted(((i is None, i or 0, t or "") for i, t in pairs(df)))
        assert sorted((i is None, i or 0, t or "") for i, t in pairs(out)) == sorted((a, b, expected[2**63 - 1 if a else b, t]) for a, b, t in before)


def test_lines_of_nothing(nothing):
    assert lines.dedup_lines(nothing).count() == 0


def test_line_signature_rates():
    """Of two lines, the share of equal values is near their Jaccard similarity."""
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        a = rng.integers(97, 123, 300)
        b = a.copy()
        b[rng.integers(0, 300, 3)] = 65
        p = np.concatenate([a, [10], b]).astype(np.uint64)
        s = lines.line_signatures(p, np.array([0, 301]), np.array([300, 601]))
        x, y = (set(lines._shingles(v.astype(np.uint64)).tolist()) for v in (a, b))
        errors.append((s[0] == s[1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("batch", [10_000, 100])
def test_shared_bands(spark, batch):
    """Each set of ids that have a band in common, once, however the rows come in batches; one band is very common, some rows repeat."""
    rng = np.random.default_rng(1)
    sig, ids = rng.integers(0, 400, (3000, 4)), rng.permutation(10**6)[:3000]
    sig[:500, 0] = 7
    ids[-200:], sig[-200:] = ids[:200], sig[:200]
    want = collections.defaultdict(set)
    for i, values in zip(ids.tolist(), sig.tolist()):
        for band in enumerate(values):
            want[band].add(i)
    rows = spark.createDataFrame([(i, s) for i, s in zip(ids.tolist(), sig.tolist())], "id long, sig array<long>").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collections.defaultdict(list)
        for r in similar.shared_bands(rows).collect():
            got[r["band"]].append(r["id"])
        assert not similar.shared_bands(rows.limit(0)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(sorted(x) for x in got.values()) == sorted(map(sorted, {frozenset(x) for x in want.values() if len(x) > 1}))


def test_lines_leave_no_signatures(spark, sf_dir):
    """Signatures, most of the scratch space, are gone before texts are shuffled."""
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("signed-*"))
    gone = lines.removed_lines(documents(spark, sf_dir))
    assert set(folder.glob("signed-*")) == before
    assert gone.limit(1).count()


# ---- 6 -------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((120, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    n = len(rows)
    for c in range(10):
        for _ in range(9):
            rows.append((n, (base[c] + rng.standard_normal(32) * 0.28).tolist()))
            n += 1
    rows += [(n, base[0].tolist()), (n + 1, (3 * base[0]).tolist()), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 32), (n + 5, [float("nan")] * 32), (n + 6, [None] * 32), (n + 7, [1.0, float("inf")]), (n + 8, [1.0, 2.0]), (n + 9, [2.0, 4.0]), (None, base[1].tolist())]
    return spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, class string, component long"), rows


def test_embeddings(spark, monkeypatch):
    df, rows = vectors(spark)
    rows = [r for r in rows if r[0] is not None]
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    linked = []
    for b, (_, v) in enumerate(rows):
        for a, (_, u) in enumerate(rows[:b]):
            if fine(v) and fine(u) and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                linked.append((a, b))
    degree = collections.Counter(x for p in linked for x in p)
    comp = components_of(range(len(rows)), linked)
    for block in (1024, 4):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {r["id"]: r for r in embeddings.near_duplicates(df.where("vec_id is not null")).collect()}
        assert len(got) == len(rows)
        assert all(got[rows[i][0]]["n_links"] <= degree[i] for i in range(len(rows)))
        found = sum(r["n_links"] for r in got.values())
        assert found >= 0.93 * sum(degree.values())  # most pairs here are at 0.9 to 0.93
        wrong = sum(got[rows[i][0]]["component_id"] != rows[comp[i]][0] for i in range(len(rows)))
        assert wrong <= 5
    assert embeddings.near_duplicates(df).count() == df.count()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5_000, 20_000, 100_000, 1_000_000, 10_000_000])
def test_filters_find_pairs_however_many_vectors(n):
    """Pairs at cosine 0.9 exactly have a common filter, and lists don't grow past what the plan says."""
    rng = np.random.default_rng(8)
    x, z = rng.standard_normal((2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    planned = embeddings.plan(64, n, 0.9, 20.0, 48.0)
    filters = embeddings.Filters(64, planned)
    one, two = (sum((filters.lists(v[i : i + 100]) for i in range(0, 500, 100)), []) for v in (x, y))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.99
    assert planned.filters <= min(map(len, one)) and np.mean([len(a) for a in one]) <= 1.5 * planned.filters


@pytest.mark.parametrize("n", [700, 6000])
def test_embeddings_end_to_end_by_filters(spark, n):
    """Half of the vectors have a partner at a cosine of 0.90 to 0.92; decoding, the join on filters and the check find nearly all of them."""
    rng = np.random.default_rng(n)
    x, z = rng.standard_normal((2, n // 2, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    c = rng.uniform(0.9001, 0.92, (n // 2, 1))
    u = np.concatenate([x, c * x + np.sqrt(1 - c**2) * z / np.linalg.norm(z, axis=1, keepdims=True)])
    assert embeddings.plan(64, n, 0.9, 20.0, 48.0).filters >= 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(u.tolist())], "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    near_ = u @ u.T >= 0.9
    np.fill_diagonal(near_, False)
    assert all(got[i][0] <= k for i, k in enumerate(near_.sum(axis=1)))
    assert sum(k for k, _ in got.values()) >= 0.98 * near_.sum() >= n * 0.98
    assert np.mean([got[i + n // 2][1] == got[i][1] for i in range(n // 2)]) >= 0.98


def test_flat_tables_are_compared_whole(spark):
    for dim, n in ((1, 50), (2, 300)):
        v = np.random.default_rng(dim).standard_normal((n, dim))
        v[n // 2 :] = v[: n - n // 2] + np.linalg.norm(v[: n - n // 2], axis=1, keepdims=True) * v[n // 2 :] * 0.45 / np.sqrt(dim)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near_ = u @ u.T >= 0.9
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        got = {r["id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
        assert [got[i] for i in range(n)] == (near_.sum(axis=1) - 1).tolist()
    assert embeddings.plan(2, 10**6, 0.9, 20.0, 48.0).filters == 0


def test_decode_lists_all():
    code = embeddings.Code(24, 3000, 0.01)
    x = np.random.default_rng(3).standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = x @ code.rotation
    all_ = (r[:, code.blocks[0]] @ code.words[0].T)[:, :, None] + (r[:, code.blocks[1]] @ code.words[1].T)[:, None, :]
    for got, row in zip(code.decode(x), all_.reshape(20, -1)):
        assert got.tolist() == np.flatnonzero(row >= code.least).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{j: 100 for j in range(101, 160)}, 201: 200}


# ---- 7 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4099])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n, 17)
    assert sorted(image.tolist()) == list(range(n))
    assert sharding.permute(image, n, 17, back=True).tolist() == list(range(n))


def test_shards(spark, odd, sf_dir):
    for df in (odd, documents(spark, sf_dir)):
        got = sharding.shard_rows(df, 16).collect()
        rows = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in pairs(df)))
        places = sharding.permute(np.arange(len(rows)), len(rows), 17).tolist()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == sorted((*r, p % 16, p // 16) for r, p in zip(rows, places))
        counts = collections.Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_shards_of_nothing(nothing):
    assert sharding.shard_rows(nothing, 16).count() == 0


# ---- 8 -------------------------------------------------------------------------------------


def labelled():
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    bad = ["grumpkin", "blatherskite", "nincompoop"]
    out = []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 6 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), int(i % 6 == 0)))
    return out


def test_toxicity_generalises(spark):
    data = labelled()
    m = toxicity.train([t for i, t, _ in data if i % 3 != 1], [y for i, _, y in data if i % 3 != 1])
    score = lambda t: max(map(m.score, m.decide(sorted(toxicity.strings(t)))))
    held = [(score(t), y) for i, t, y in data if i % 3 == 1]
    assert all((s >= 0.7) == bool(y) for s, y in held)
    for t in ("Grumpkin!", "grum*pkin", "grummpkin", "blather.skite", "n i n c o m p o o p"):
        assert score(t) >= 0.5, t
    assert score("rose tree lent stone") < 0.3


def test_rare_insults_are_rejected():
    """A hundred and fifty insults, each in well under 1 % of the toxic documents."""
    import random

    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(6000)]
    bad = ["".join(rng.choice("bcdfgkmpvwz") + rng.choice("aeiou") for _ in range(4)) + rng.choice("kpxz") for _ in range(150)]
    data = []
    for i in range(7200):
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), bad[i // 5 % 150])
        data.append((i, " ".join(w), int(i % 5 == 0)))
    m = toxicity.train([t for i, t, _ in data], [y for *_, y in data])
    score = lambda t: max(map(m.score, m.decide(sorted(toxicity.strings(t)))))
    assert np.mean([score(t) >= 0.7 for t in bad]) >= 0.99
    assert np.mean([score(v) >= 0.7 for t in bad for v in (t[:4] + "*" + t[4:], t[:3] + t[2] + t[3:], " ".join(t))]) >= 0.95
    clean = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(300)]
    assert np.mean([score(t) >= 0.7 for t in clean]) <= 0.01


def test_weaker_insults_if_none_is_sure():
    """Two insults in three documents each, among few."""
    docs = [(f"plain{i} text{i} of{i} words{i}", 0) for i in range(40)] + [(f"plain{i} text{i} {'grumpkin' if i % 2 else 'blatherskite'} more{i}", 1) for i in range(40, 46)]
    m = toxicity.train([t for t, _ in docs], [y for _, y in docs])
    score = lambda t: max(map(m.score, m.decide(sorted(toxicity.strings(t)))))
    assert min(score("grumpkin"), score("grum*pkin"), score("blatherskite")) >= 0.7 > score("plain3 words4 of5")


def phi(text):
    """Triples of characters within five, the ends counted, by the definition."""
    t, out = "\x02" + text + "\x03", collections.Counter()
    for i in range(len(t)):
        for j in range(i + 1, len(t)):
            for k in range(j + 1, min(len(t), i + 5)):
                out[t[i] + t[j] + t[k]] += toxicity.DECAY ** (k - i - 2)
    return out


def kernel(a, b):
    x, y = phi(a), phi(b)
    dot = lambda u, v: sum(n * v[c] for c, n in u.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


SOME = ["abcab", "a", "idiot", "id*iot", "iddiot", "дурак", "дурачок", "馬鹿", "aaaa", "é", "stone", "trees"]


def test_kernel_is_the_definition():
    row, code, value = toxicity._triples(SOME)
    for i, t in enumerate(SOME):
        assert sorted(value[row == i].round(9)) == sorted(round(v, 9) for v in phi(t).values())
    x = np.zeros((len(SOME), 1 << 20))
    x[row, code] = value
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(x @ x.T, [[kernel(a, b) for b in SOME] for a in SOME])
    assert kernel("дурак", "馬鹿") < 0.2 < 0.4 < kernel("idiot", "iddiot")


def test_folded_weights_are_the_machine_on_the_landmarks():
    rng = np.random.default_rng(4)
    ny = toxicity.Nystroem(SOME[:8])
    w, bias = rng.standard_normal(ny.white.shape[1]), 0.3
    new = [*SOME, "idiots", "дура", "wholly new"]
    k = np.array([[kernel(t, m) for m in SOME[:8]] for t in new])
    assert np.allclose(k[:8] @ np.linalg.pinv(k[:8]) @ k[:8].T, ny.embed(SOME[:8]) @ ny.embed(SOME[:8]).T, atol=1e-6)
    assert np.allclose(k @ ny.white @ w + bias, ny.folded(w, bias).decide(new))


def test_witnesses_of_sentences():
    """A sentence's witness is its string of the largest value; believed are those that toxic documents have in common."""
    docs = [(f"plain{i} text{i}. of{i} words{i} here.", -1) for i in range(60)] + [(f"plain{i} text{i}. more{i} grumpkin here.", 1) for i in range(60, 72)]
    bags = toxicity.Bags([t for t, _ in docs], np.array([y for _, y in docs]))
    value = np.array([2.0 if n == "grumpkin" else 1.0 if n.startswith("text") else 0.0 if n == "here" else -1.0 for n in bags.names])
    name = lambda at: {bags.names[i] for i in at}
    assert name(bags.witnesses(value, True)) == {"grumpkin", *(f"text{i}" for i in range(60, 72))}
    assert name(bags.believed(bags.witnesses(value, True))) == {"grumpkin"}
    assert name(bags.witnesses(value, False)) == {"here", *(f"text{i}" for i in range(60))}


def test_only_training_folds_teach(spark):
    """Texts and labels of the held-out fold change nothing in the machine."""
    data = labelled()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    machines = []
    for flip in (False, True):
        docs = spark.createDataFrame([(i, t + " xyzzy" if flip and held(i) else t) for i, t, _ in data], "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(not y) if flip and held(i) else y) for i, _, y in data], "doc_id long, toxic int")
        machines.append(toxicity.fit(docs, labels))
    assert len(machines[0].triples) and machines[0].decide(SOME).tolist() == machines[1].decide(SOME).tolist()


def test_held_out_documents(spark):
    """Of the query itself: held-out toxic documents are rejected, clean ones are not."""
    at = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] for r in held if r["toxic"]) >= 0.7 * sum(r["toxic"] for r in held) > 0  # 286 documents teach
    assert sum(r["predicted"] for r in held if not r["toxic"]) == 0


def test_toxicity_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(odd, labels)
    got = toxicity.scored(odd, m)
    assert got.count() == odd.count() and got.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0


# ---- 9 -------------------------------------------------------------------------------------


def test_near_duplicates(spark, odd, sf_dir, monkeypatch):
    for df in (odd, documents(spark, sf_dir)):
        expected = near(pairs(df))
        by_digest = {(i, hashlib.md5(t.encode()).hexdigest()): c for (i, t), c in expected.items()}
        got = neardup.near_classes(df).collect()
        last = 2**63 - 1
        assert {(last if r["doc_id"] is None else r["doc_id"], r["digest"]): (last if r["component_id"] is None else r["component_id"]) for r in got} == by_digest
        assert len(got) == df.count()
        rows_kept = collections.Counter((r["doc_id"], r["digest"]) for r in got if r["kept"])
        assert set(rows_kept.values()) == {1}
        kept = neardup.keep_one(df)
        assert kept.columns == df.columns
        assert kept.count() >= len(set(expected.values()))
    assert neardup.keep_one(documents(spark, sf_dir)).count() == len(set(expected.values()))


def test_near_nothing(nothing):
    assert neardup.near_classes(nothing).count() == 0 and neardup.keep_one(nothing).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    from evidora.llm import pairs as p

    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i:])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, most in ((8, 10**9), (512, 2_000)):
        monkeypatch.setattr(p, "BLOCK", block)
        monkeypatch.setattr(p, "BYTES", most)
        assert {r["component_id"] for r in neardup.near_classes(df).collect()} == {0}


def test_large_groups_lose_no_link(spark, monkeypatch):
    """One key with a large cluster, small ones, a chain and lone items, in blocks of eight."""
    import pyarrow as pa

    from evidora.llm import pairs as p

    rng = np.random.default_rng(3)
    value = [0] * 70 + [1] * 9 + [2, 2, 3] + [10 + i / 2 for i in range(30)] + [100 + 2 * i for i in range(25)]
    rows = [("x" if i % 7 else "y", int(k), float(v)) for i, (k, v) in enumerate(zip(rng.permutation(len(value)), value))]

    def compare(table: pa.Table, bounds):
        ids, v, grp = (table.column(c).to_numpy() for c in ("id", "value", "grp"))
        near_ = (np.abs(v[:, None] - v[None, :]) <= 0.5) & (grp[:, None] == grp[None, :])
        assert np.bincount(np.unique(grp, return_inverse=True)[1]).max() <= 64
        a, b = np.nonzero(near_)
        return p._towards(ids, a, b)

    monkeypatch.setattr(p, "BLOCK", 8)
    df = spark.createDataFrame(rows, "key string, id long, value double")
    got = {r["node"]: r["root"] for r in graph.components(p.linked(df, "key", compare)).collect()}
    links = [(a, b) for k, a, u in rows for l, b, v in rows if k == l and a < b and abs(u - v) <= 0.5]
    expected = components_of([k for _, k, _ in rows], links)
    assert got == {k: c for k, c in expected.items() if k != c}


def test_weighted_jaccard_is_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(80):
        a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
        names = rng.integers(0, 2**63, 60).astype(np.uint64)
        rows = [(np.full((x > 0).sum(), i), names[x > 0], x[x > 0]) for i, x in enumerate((a, b))]
        s = bagminhash.signatures(*(np.concatenate(c) for c in zip(*rows)), 2, 128)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


# ---- 10 ------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, sf_dir):
    for df in (documents(spark, sf_dir), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
        rows = sorted(((i, t or "") for i, t in pairs(df)), reverse=True)
        assert len(got) == len(rows)
        marks = {}
        for at, (i, t) in enumerate(rows):
            nxt = rows[(at + 1) % len(rows)]
            e = t[: len(t) - len(t) // 2] + nxt[1][: len(t) // 2]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert marks.setdefault(t, r["fingerprint"]) == r["fingerprint"]
            a, b = r["fingerprint"].split("."), got[nxt[0]]["fingerprint"].split(".")
            n = max(len(a), len(b))
            both = list(zip(a + ["-"] * (n - len(a)), b + ["-"] * (n - len(b))))
            either = [p for p in both if p != ("-", "-")]
            expected = 1.0 if a == b else sum(x == y for x, y in either) / len(either)
            assert abs(r["near_next"] - expected) < 1e-12 and 0 <= r["near_edited"] <= 1


def terms_and_subsets(spark, texts):
    """Of each text its terms, by regular expression; of each term its hash and the subsets that it is in."""
    import regex

    term_sets = {t: sorted(set(regex.findall(r"[\p{L}\p{N}]+", t.lower()))) for t in texts}
    names = sorted({x for s in term_sets.values() for x in s})
    hashes = spark.createDataFrame([(x,) for x in names], "t string").withColumn("h", F.xxhash64("t"))
    seeds = [F.pmod(F.xxhash64("h", F.lit(i)), F.lit(r)) == 0 for i, r in enumerate(fingerprints.RATES)]
    rows = hashes.select("t", "h", F.array(*seeds).alias("m")).collect()
    return term_sets, {r["t"]: (r["h"], r["m"]) for r in rows}


def test_fingerprints_by_brute_force(spark, sf_dir, monkeypatch):
    """Lexicon, subsets and both fingerprints, on either side of the lexicon's size limit."""
    df = documents(spark, sf_dir)
    rows = sorted(((i, t or "") for i, t in pairs(df)), reverse=True)
    edits = {i: t[: len(t) - len(t) // 2] + rows[(at + 1) % len(rows)][1][: len(t) // 2] for at, (i, t) in enumerate(rows)}
    sets, known = terms_and_subsets(spark, [t for _, t in rows] + list(edits.values()))
    counts = collections.Counter(x for _, t in rows for x in sets[t])
    lexicon = {x for x, n in counts.items() if max(2, 0.001 * len(rows)) <= n <= max(2, 0.02 * len(rows))}
    lists = {t: [sorted(known[x][0] for x in s if x in lexicon and known[x][1][i]) for i in range(len(fingerprints.RATES))] for t, s in sets.items()}
    flat = [(t, i, v) for t, some in lists.items() for i, v in enumerate(some) if v]
    hashed = spark.createDataFrame(flat, "t string, i int, v array<long>").select("t", "i", F.substring(F.lpad(F.lower(F.hex(F.xxhash64("v"))), 16, "0"), 1, 10).alias("x")).collect()
    part = {(r["t"], r["i"]): r["x"] for r in hashed}
    whole = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in sets], "t string").select("t", F.lower(F.hex(F.xxhash64("t"))).alias("x")).collect()}
    expected = {t: ".".join(part.get((t, i), "-") for i in range(len(fingerprints.RATES))) if any(lists[t]) else "#" + whole[t].rjust(16, "0") for t in sets}
    for most in (1_000_000, 0):
        monkeypatch.setattr(fingerprints, "BROADCAST_TERMS", most)
        got = fingerprints.edited_fingerprints(df).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (expected[texts[r["doc_id"]]], expected[edits[r["doc_id"]]])


def test_fingerprints_of_odd_rows(odd, nothing):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in pairs(odd))
    assert fingerprints.edited_fingerprints(nothing).count() == 0
