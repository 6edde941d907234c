"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

import numpy as np

# Alphabets up to this size are induced bucket by bucket in whole arrays; larger ones, in the recursion, position by position.
SMALL_ALPHABET = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a text of integers >= 0 whose last symbol is 0 and occurs nowhere else.

    Suffixes are smaller (S) or larger (L) than their successor. Leftmost-S substrings are sorted by one induction and named;
    if names repeat, the shorter text of names is sorted recursively; a second induction gives the whole order.
    """
    text = np.ascontiguousarray(text)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _smaller(text)
    left = np.zeros(n, bool)
    left[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(left)
    counts = np.bincount(text)
    induce = _induce_buckets if len(counts) <= SMALL_ALPHABET else _induce_positions
    if len(places) == 1:
        return induce(text, small, places, counts)
    rough = induce(text, small, places, counts)
    rough = rough[left[rough]]
    names, known = _names(text, places, rough)
    if known == len(places):
        order = np.empty(len(places), np.int64)
        order[names] = np.arange(len(places))
    else:
        order = suffix_array(names)
    return induce(text, small, places[order], counts)


def _smaller(text: np.ndarray) -> np.ndarray:
    """S types: smaller than the next different symbol; the end is S."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1
    decided = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _names(text: np.ndarray, places: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the leftmost-S substrings in their order, laid out in text order, and how many differ."""
    number = np.empty(len(text), np.int64)
    number[places] = np.arange(len(places))
    length = np.append(np.diff(places) + 1, 1)[number[rough]]
    same = length[1:] == length[:-1]
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        equal = text[rough[active] + offset] == text[rough[active + 1] + offset]
        same[active[~equal]] = False
        offset += 1
        active = active[equal]
        active = active[length[active] > offset]
    names_sorted = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(places), np.int64)
    names[number[rough]] = names_sorted
    return names, int(names_sorted[-1]) + 1


def _induce_buckets(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One induction in whole arrays: a bucket is read in waves, as reading it may add to its own end."""
    n, sigma = len(text), len(counts)
    out = np.zeros(n, np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    narrow = text.astype(np.uint16)
    by_symbol = np.argsort(narrow[seeds], kind="stable")
    seeds = seeds[by_symbol]
    seed_edges = np.concatenate([[0], np.cumsum(np.bincount(text[seeds], minlength=sigma))])
    head = begins.copy()

    def scatter(at: np.ndarray, is_small: bool) -> tuple | None:
        before = at[at > 0] - 1
        before = before[small[before] == is_small]
        if not len(before):
            return None
        symbols = narrow[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        added = np.bincount(symbols, minlength=sigma)
        rank = np.arange(len(before)) - np.repeat(np.cumsum(added) - added, added)
        return before, symbols, added, rank

    symbols_used = np.flatnonzero(counts)
    for c in symbols_used:
        read = begins[c]
        while read < head[c]:
            now, read = out[read : head[c]], head[c]
            if (got := scatter(now, False)) is not None:
                out[head[got[1]] + got[3]] = got[0]
                head += got[2]
        if seed_edges[c] < seed_edges[c + 1] and (got := scatter(seeds[seed_edges[c] : seed_edges[c + 1]], False)) is not None:
            out[head[got[1]] + got[3]] = got[0]
            head += got[2]
    tail = ends.copy()
    tail[0], out[0] = 0, n - 1
    for c in symbols_used[::-1]:
        read = ends[c] if c else 0
        while tail[c] < read:
            now, read = out[tail[c] : read][::-1], tail[c]
            if (got := scatter(now, True)) is not None:
                out[tail[got[1]] - 1 - got[3]] = got[0]
                tail -= got[2]
        if begins[c] < head[c] and (got := scatter(out[begins[c] : head[c]][::-1], True)) is not None:
            out[tail[got[1]] - 1 - got[3]] = got[0]
            tail -= got[2]
    return out


def _induce_positions(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One induction position by position, for large alphabets."""
    symbols, is_small, n = text.tolist(), small.tolist(), len(text)
    out = [-1] * n
    tail = np.cumsum(counts).tolist()
    for p in seeds[::-1].tolist():
        c = symbols[p]
        tail[c] -= 1
        out[tail[c]] = p
    head = (np.cumsum(counts) - counts).tolist()
    for p in out:  # grows ahead of the reader
        if p > 0 and not is_small[p - 1]:
            c = symbols[p - 1]
            out[head[c]] = p - 1
            head[c] += 1
    tail = np.cumsum(counts).tolist()
    for k in range(n - 1, -1, -1):
        p = out[k]
        if p > 0 and is_small[p - 1]:
            c = symbols[p - 1]
            tail[c] -= 1
            out[tail[c]] = p - 1
    out[0] = n - 1
    return np.array(out, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each sorted suffix with the one before it (0 for the first), by way of text order.

    In text order a value is at least the one before less 1, and exactly that where both suffixes follow the same symbol; only
    the other, irreducible places are compared, eight symbols at a time. Symbols are below 2**16.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (text[places[1:] - 1] == text[np.maximum(before[1:], 1) - 1])
    start = np.flatnonzero(~chained)
    length = np.zeros(len(start), np.int64)
    padded = np.concatenate([text.astype(np.uint16), np.zeros(16, np.uint16)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (2, 2))
    active = np.flatnonzero(before[start] >= 0)
    while len(active):
        a, b = start[active] + length[active], before[start[active]] + length[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        equal = words[a] == words[b]
        run = np.where(equal.all(1), 8, equal.argmin(1))
        length[active] += run
        active = active[run == 8]
    last = np.maximum.accumulate(np.where(chained, -1, np.cumsum(~chained) - 1))
    value = np.maximum(length[last] - (places - start[last]), 0)
    return value[order]
