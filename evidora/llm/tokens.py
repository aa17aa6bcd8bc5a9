"""Token ids by a public byte-level BPE vocabulary, cut into pieces of a sequence's length."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 1024
END = 2


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE files write for each byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    """An encoder of the `tokenizers` file at path (none: the public package's VOCABULARY).

    tiktoken runs it, several times as fast as `tokenizers` at the same ids; tests compare the two.
    The file's added tokens are one id wherever they stand in a text, as there. One per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, letters = file["model"]["vocab"], _byte_letters()
    special = {t["content"]: t["id"] for t in file.get("added_tokens") or ()}
    ranks = {bytes(letters[c] for c in k): i for k, i in vocabulary.items() if k not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str | None = None, end: int = END) -> np.ndarray:
    """The ids of text (null: none), then the end id."""
    ids = encoding(path).encode(text, allowed_special="all") if text else []
    ids.append(end)
    return np.array(ids, dtype="<u4")


def cuts(n: int, most: int = SEQUENCE) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of n ids: whole if it fits, else pieces of most ids
    of which the first may be shorter."""
    if n <= most:
        yield 0, 0, n
        return
    first = n % most or most
    yield 0, 0, first
    for i, start in enumerate(range(first, n, most), 1):
        yield i, start, most
