"""BagMinHash: weighted-Jaccard signatures from hierarchical Poisson processes.

An element with weight w owns the interval (0, w] of the weight axis, which is discretised dyadically:
(0, 1], (1, 2], (2, 4], (4, 8] and so on. Each (element, interval) is a Poisson process in
time whose rate is the interval's length; each of its points falls on a uniform place of the interval and
on a uniform component of the signature. Points above w are thinned out, those below count,
in every bag that has the element at that weight, at the same time and component. A
component's value is the first point that reaches it; two bags agree in it with a chance of exactly
sum(min) / sum(max) of their weights, their weighted Jaccard similarity. Points come in order of time, so a process
stops once it is past the largest component's value.
"""

from __future__ import annotations

import numpy as np

from evidora.llm.hashing import U, mix

_TO_UNIT = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * _TO_UNIT


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k signature values (uint64; 0 where a bag is empty) of bags in rows
    (doc, element hash, weight >= 1, integer or not)."""
    time = np.full(n_docs * k, np.inf)
    value = np.zeros(n_docs * k, U)
    doc, element, weight = doc.astype(np.int64), element.astype(U), weight.astype(np.float64)
    level = np.zeros(len(doc), np.int64)
    low, rate = np.zeros(len(doc)), np.ones(len(doc))
    parts = [(doc, element, weight, level, low, rate)]
    over, depth = np.flatnonzero(weight > 1), 1
    while len(over):  # the further dyadic intervals of heavier elements
        start = float(2 ** (depth - 1))
        parts.append((doc[over], element[over], weight[over], np.full(len(over), depth), np.full(len(over), start), np.full(len(over), start)))
        over, depth = over[weight[over] > 2 * start], depth + 1
    doc, element, weight, level, low, rate = (np.concatenate(x) for x in zip(*parts))
    with np.errstate(over="ignore"):
        state = mix(element + (level.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
        at = np.zeros(len(doc))
        step = 0
        while len(doc):
            step += 1
            state = mix(state + U(0xD1342543DE82EF95))
            at = at - np.log(_unit(state)) / rate
            second = mix(state ^ U(0xA0761D6478BD642F))
            component = ((second >> U(40)) % U(k)).astype(np.int64)
            counts = rate == 1
            if not counts.all():
                counts = low + rate * _unit(mix(second)) < weight
            slot = doc * k + component
            s, t, v = (slot, at, second) if counts.all() else (slot[counts], at[counts], second[counts])
            order = np.lexsort((v, t, s))
            s, t, v = s[order], t[order], v[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
            s, t, v = s[head], t[head], v[head]
            better = t < time[s]
            time[s[better]], value[s[better]] = t[better], v[better]
            open_ = at < time.reshape(n_docs, k).max(axis=1)[doc]
            if not open_.all():
                doc, weight, low, rate, state, at = (x[open_] for x in (doc, weight, low, rate, state, at))
    return value.reshape(n_docs, k)
