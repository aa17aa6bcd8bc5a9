"""The operators' results by brute force, in plain Python, and checks of whole results."""

import collections
import hashlib
import re
import zlib

import numpy as np

from evidora.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def removed(rows, window):
    """By brute force: (id, number of words, flags) of each row."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


def all_ids(rows):
    """By the tokenizers library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in rows]


def check_pieces(df, got, sequences_over=0.05):
    ids = all_ids(pairs(df))
    expected = sorted((str(i), p, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, x in ids for p, s, n in tokens.cuts(len(x)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(by) <= max(least + 2, least * (1 + sequences_over))


def water(sizes, share=1.5, most=2.0):
    """The rule as it is told: shares by weight, what is over a cap goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = share * sum(sizes.values()), set(names)
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += rest * w[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        rest = over
    return target


def components_of(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def kept_lines(rows, least=0.8):
    rows = sorted({(2**63 - 1 if i is None else i, zlib.crc32((t or "").encode()), t or "") for i, t in rows})
    all_ = [(i, tag, n, x) for i, tag, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    keys = list(dict.fromkeys(x for *_, x in all_))
    sets = [{k[j : j + 8] for j in range(len(k) - 7)} for k in keys]
    linked = [(a, b) for b in range(len(keys)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    comp = components_of(range(len(keys)), linked)
    at = {k: i for i, k in enumerate(keys)}
    stays = {}
    for i, tag, n, x in all_:
        c = comp[at[x]]
        stays[c] = min(stays.get(c, (i, tag, n)), (i, tag, n))
    gone = {(i, tag, n) for i, tag, n, x in all_ if stays[comp[at[x]]] != (i, tag, n)}
    return {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if (i, tag, n) not in gone) for i, tag, t in rows}


def near(rows, least=0.8):
    """{(id, text): (smallest id of its component)} by brute force; null ids come last."""
    rows = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    bags = []
    for _, t in rows:
        w = WORD.findall(t)
        bags.append(collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)))
    linked = []
    for b in range(len(rows)):
        for a in range(b):
            low, high = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if rows[a][1] == rows[b][1] or high and low >= least * high:
                linked.append((a, b))
    comp = components_of(range(len(rows)), linked)
    return {r: rows[comp[i]][0] for i, r in enumerate(rows)}
