"""Suffix sorting to a bounded depth, deep-shallow: multikey quicksort first, blind tries for what stays equal."""

from __future__ import annotations

import numpy as np

from tessera.llm.anchors import eights, mix

SYMBOL, SHALLOW = 8, 2


class BlindTrie:
    """Orders distinct strings by their branching bytes; an inner node is [depth, {byte: child}], a leaf an index."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):  # blindly: bytes between branches aren't looked at
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        d = next((k for k in range(len(s)) if s[k] != other[k]), len(s))
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < d:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == d:
            node[1][s[d]] = i
            return
        split = [d, {other[d]: node, s[d]: i}]
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the depth-byte strings that start at ``starts``: (their order, whether each equals its predecessor in it).

    Shallow: multikey quicksort by 8-byte symbols, all open groups at once, to
    SHALLOW symbols. Deep: in every group that is still open equal remainders
    are put together (found by a hash, confirmed by their bytes), and a blind
    trie orders the distinct ones.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, "i8"), np.zeros(0, bool)
    x = eights(buf).byteswap()
    order = np.argsort(x[starts], kind="stable")
    key = x[starts[order]]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for k in range(1, SHALLOW):
        group = np.cumsum(new) - 1
        open_ = (np.bincount(group) > 1)[group]
        at = np.flatnonzero(open_)
        key = x[starts[order[at]] + k * SYMBOL]
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        g, key = group[at][by], key[by]
        if len(at):
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
            new[at] = fresh
    group = np.cumsum(new) - 1
    at = np.flatnonzero((np.bincount(group) > 1)[group])
    if not len(at):
        return order, ~new
    # remainders by hash
    rest = SHALLOW * SYMBOL
    h = np.zeros(len(at), "u8")
    s = starts[order[at]]
    for k in [*range(rest, depth - SYMBOL + 1, SYMBOL), depth - SYMBOL]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[s + k])
    g = group[at]
    by = np.lexsort((h, g))
    order[at], h, s = order[at][by], h[by], s[by]
    edge = np.concatenate([[True], g[1:] != g[:-1]])
    first = edge | np.concatenate([[True], h[1:] != h[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    symbols = [*range(rest, depth - SYMBOL + 1, SYMBOL), depth - SYMBOL]
    if any((x[s + k] != x[s[head] + k]).any() for k in symbols):  # two remainders with one hash: by their bytes alone
        by = np.lexsort((*[x[s + k] for k in reversed(symbols)], g))
        order[at], s = order[at][by], s[by]
        new[at] = edge | np.concatenate([[True], np.any([x[s[1:] + k] != x[s[:-1] + k] for k in symbols], axis=0)])
        return order, ~new
    new[at] = first
    # blind tries where a group has several remainders
    n_first = np.bincount(np.cumsum(edge) - 1, weights=first).astype("i8")
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], len(at))
    firsts = np.flatnonzero(first)
    at_first = np.searchsorted(firsts, begins)
    # of two remainders the first symbol that differs tells the order
    two = np.flatnonzero(n_first == 2)
    f0, f1, end = firsts[at_first[two]], firsts[at_first[two] + 1], ends[two]
    later = np.zeros(len(two), bool)
    open_ = np.ones(len(two), bool)
    for k in [*range(rest, depth - SYMBOL + 1, SYMBOL), depth - SYMBOL]:
        a, b = x[s[f0] + k], x[s[f1] + k]
        later |= open_ & (a > b)
        open_ &= a == b
    n0, n1 = (f1 - f0)[later], (end - f1)[later]
    at_old = np.repeat(f0[later] - np.cumsum(n0 + n1) + n0 + n1, n0 + n1) + np.arange((n0 + n1).sum())
    in_first = at_old < np.repeat(f1[later], n0 + n1)
    at_new = at_old + np.where(in_first, np.repeat(n1, n0 + n1), -np.repeat(n0, n0 + n1))
    order[at[at_new]], new[at[at_new]] = order[at[at_old]], new[at[at_old]]
    data = buf.tobytes()
    for i in np.flatnonzero(n_first > 2):
        b, e = begins[i], ends[i]
        f = firsts[at_first[i] : at_first[i] + n_first[i]]
        strings = [data[p + rest : p + depth] for p in s[f].tolist()]
        ranked = BlindTrie(strings).order()
        if ranked != sorted(ranked):
            runs = [np.arange(f[j], f[j + 1] if j + 1 < len(f) else e) for j in ranked]
            moved = np.concatenate(runs)
            order[at[b:e]] = order[at[moved]]
            new[at[b:e]] = np.concatenate([np.arange(len(r)) == 0 for r in runs])
    return order, ~new
