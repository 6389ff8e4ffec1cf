"""Substring dedup by compact windows.

Tokens are word shingles.  For each of `hashes` hash functions, a text's
compact windows are the maximal runs of at least `width` shingles in which one
shingle has the smallest hash: the nodes of the Cartesian tree over the
hashes whose span is wide enough.  All subsequences inside such a span that
hold its centre share that min-hash, so two texts with a near-duplicate
passage have windows of the same centre for most functions.

Windows meet by their centre's hash; each is joined with the smallest document
that has it, never with all others, so a passage that very many documents
share costs one pair per document.  Window pairs of two documents are joined
by their intervals, counted over the functions, and verified on the texts.
Windows of verified pairs are settled; keys with others meet again in a second
round, by their centre together with the shingles before or behind it (16 bits
of each are kept with every window), which parts chance meetings from passages.
Keys that are still open meet by every run of min_words words around their
centre, so that shorter fragments in smaller documents cannot keep documents
with a verbatim passage apart.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .jaccard import BROADCAST_IDS
from .store import cut, fresh, kept, new_path, remove, scratch, written, written_at

_U = np.uint64
#: Bytes of text whose windows are sought at once, so that the arrays stay in a core's cache.
CACHED = 1 << 18
#: Places of equal shingles in two texts that are looked at together; with so many a place, on average, only those that begin a run are.
PAIRS, EVERY_PAIR = 1 << 20, 4
#: Later documents that meet an earlier one in one task, on average.
TOGETHER = 2_000
_SALTS = W.mix(np.arange(1, 65, dtype=_U) * _U(0xABCDEF123456789))


def compact_windows(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), inclusive, of the windows of at least width places with a single smallest centre.

    h are hashes, text the number of the text of each place; equal hashes
    count the leftmost as smaller, and so do hashes that differ in their lowest
    bits only (as many as number the places).  A place with a wide window is the minimum
    of some run of width places, and the nearest smaller places around it are
    such minima too or ends of the text, so the tree is built over minima of
    sliding runs alone (about 2 in width places).
    """
    n = len(h)
    z = np.zeros(0, np.int64)
    if n < width:
        return z, z, z
    # sliding minima by doubling, of hashes whose low bits give way to the place: ties keep the leftmost
    low = np.uint64((1 << max(1, n - 1).bit_length()) - 1)
    h = h & ~low
    least, span = h | np.arange(n, dtype=_U), 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & low).astype(np.int64)
    inside = text[: n - width + 1] == text[width - 1 :]
    is_centre = np.zeros(n, bool)
    is_centre[at[inside]] = True
    centre = np.flatnonzero(is_centre)
    if not len(centre):
        return z, z, z
    c, t = h[centre], text[centre]
    m = len(centre)
    previous = _nearest(c, t, m)
    following = m - 1 - _nearest(c[::-1], t[::-1], m, strict=True)[::-1]
    first = np.searchsorted(text, t, side="left")
    last = np.searchsorted(text, t, side="right") - 1
    left = np.where(previous >= 0, centre[np.maximum(previous, 0)] + 1, first)
    right = np.where(following < m, centre[np.minimum(following, m - 1)] - 1, last)
    # of equal minima in a row, the first one's window holds the others'
    first_of = ~((previous >= 0) & (c[np.maximum(previous, 0)] == c))
    wide = (right - left + 1 >= width) & first_of
    return left[wide], centre[wide], right[wide]


def _nearest(c: np.ndarray, t: np.ndarray, m: int, strict: bool = False) -> np.ndarray:
    """Nearest earlier place of the same text that is smaller (or equal, unless strict); else -1."""
    at = np.arange(m) - 1
    at[np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))] = -1
    at = at.tolist()
    c = c.tolist()
    for k in range(m):
        p, own = at[k], c[k]
        while p >= 0 and (c[p] >= own if strict else c[p] > own):
            p = at[p]  # what the greater place skips, this one skips too
        at[k] = p
    return np.array(at, np.int64)


def _fingerprints(grams: np.ndarray, text: np.ndarray, half: int) -> np.ndarray:
    """16 bits for the half shingles up to each place and 16 for those from it on; 0 where the text ends before."""
    n = len(grams)
    bits = (W.run_hashes(grams, half) >> _U(48)).astype(np.uint32)
    bits[bits == 0] = 1
    bits[text[: len(bits)] != text[half - 1 :][: len(bits)]] = 0
    after, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    after[: len(bits)] = bits
    before[n - len(bits) :] = bits
    return ((before << np.uint32(16)) | after).view(np.int32)


def _windows(width: int, hashes: int, gram: int, names: list[str]):
    half = max(1, width // 2)

    def run(batches):
        for batch in batches:
            for i, j, w in W.batches_of(batch.column(1), lower=True, limit=CACHED):
                words, text = w.hashes(), w.text_of_word()
                grams = W.ngram_hashes(words, gram)
                inside = text[: len(grams)] == text[gram - 1 :] if len(grams) else np.zeros(0, bool)
                grams, own = grams[inside], text[: len(inside)][inside]
                base = np.searchsorted(own, np.arange(j - i))
                around = _fingerprints(grams, own, half)
                parts = []
                for f in range(hashes):
                    left, centre, right = compact_windows(W.mix(grams ^ _SALTS[f]), own, width)
                    doc = own[centre]
                    parts.append((doc, W.mix(grams[centre] + _U(f)), left - base[doc], centre - base[doc], right - base[doc], around[centre]))
                doc, key, left, centre, right, ctx = (np.concatenate([p[k] for p in parts]) for k in range(6))
                order = np.argsort(doc, kind="stable")
                edge = np.searchsorted(doc[order], np.arange(j - i + 1))
                values = [pa.array(W.signed(key[order])), *(pa.array(x[order].astype(np.int32)) for x in (left, centre, right, ctx))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), v) for v in values)], names=names)

    return run


def _shingles(raw: memoryview | bytes, gram: int) -> tuple[np.ndarray, W.Words]:
    data = np.frombuffer(raw, np.uint8)
    w = W.Words(data, np.array([0, len(data)]), lower=True)
    return W.ngram_hashes(w.hashes(), gram), w


def _after(x: np.ndarray) -> np.ndarray:
    """A hash of each place's value and the one before it."""
    return W.mix(x ^ W.mix(np.concatenate([np.zeros(min(1, len(x)), _U), x[:-1]]) + _U(1)))


class _Places:
    """The places of a sequence by value and, when first asked for, by value and the value before."""

    def __init__(self, b: np.ndarray):
        self.b = b
        self.order = np.argsort(b, kind="stable")
        self.values = b[self.order]

    @functools.cached_property
    def by_pair(self) -> tuple[np.ndarray, ...]:
        """(places, the pairs of both values in order, where each pair's places begin and end)."""
        pair = _after(self.b)
        order = np.lexsort((pair, self.b))
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        last = np.append(first[1:], len(self.b))
        by = np.argsort(pair[first], kind="stable")
        return order, pair[first][by], first[by], last[by]


def _prefix(x: np.ndarray) -> np.ndarray:
    power, _ = W._power_tables(len(x) + 1)
    total = np.zeros(len(x) + 1, _U)
    np.cumsum(x * power[: len(x)], out=total[1:])
    return total


def _common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many places from i in a and from j in b on are equal: by hashes of stretches twice as long while they agree, then half as long."""
    _, inverse = W._power_tables(max(len(a), len(b)) + 1)
    sums = _prefix(a), _prefix(b)
    size, most = np.zeros(len(i), np.int64), np.minimum(len(a) - i, len(b) - j)

    def equal(at: np.ndarray, n: int) -> np.ndarray:
        x, y = i[at] + size[at], j[at] + size[at]
        return (sums[0][x + n] - sums[0][x]) * inverse[x] == (sums[1][y + n] - sums[1][y]) * inverse[y]

    open_, n, steps = np.arange(len(i)), 1, []
    while len(open_):
        open_ = open_[size[open_] + n <= most[open_]]
        open_ = open_[equal(open_, n)]
        size[open_] += n
        steps.append(n)
        n *= 2
    for n in reversed(steps):
        at = np.flatnonzero(size + n <= most)
        size[at[equal(at, n)]] += n
    return size


def _matches(a: np.ndarray, b: np.ndarray, places: _Places | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of the maximal equal runs of a and b, over all occurrences, by their place in a; places are b's.

    Few pairs of equal places are all made and joined along diagonals.  Where
    shingles repeat, only pairs that begin a run are made, equal values with
    unequal ones before: two texts of one word repeated have as many of these
    as places, not as pairs of places.  Both ways give the same runs.
    """
    if not len(a) or not len(b):
        return (np.zeros(0, np.int64),) * 3
    places = places or _Places(b)
    low, high = np.searchsorted(places.values, a), np.searchsorted(places.values, a, side="right")
    n = high - low
    if n.sum() <= EVERY_PAIR * (len(a) + len(b)):
        i = np.repeat(np.arange(len(a)), n)
        j = places.order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low, n)]
        key, size = _joined((j - i + len(a)) * np.int64(len(a) + 1) + i, 1)
        i = key % (len(a) + 1)
        j = key // (len(a) + 1) - len(a) + i
    else:
        i, j, size = _begun(a, b, low, high, places)
    by = np.lexsort((j, i))
    return i[by], j[by], size[by]


def _joined(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of keys joined where one ends as the next begins: a key is a diagonal and a place on it."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + size])) if len(key) else np.zeros(0, np.int64)
    return key[first], size * np.diff(np.append(first, len(key)))


def _begun(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, places: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, pairs, first, last = places.by_pair
    pair = _after(a)
    at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    same = pairs[at] == pair
    same[:1] = False
    # the places of the same value before are left out, but for one at the beginning of b
    skip, resume = np.where(same, first[at], high), np.where(same, last[at], high)
    n = (skip - low) + (high - resume)
    begin = np.concatenate([[0], np.cumsum(n)])
    parts, k = [], 0
    while k < len(a):  # places of a with about PAIRS places of b at a time
        end = max(k + 1, int(np.searchsorted(begin[1:], begin[k] + PAIRS, side="right")))
        i = np.repeat(np.arange(k, end), n[k:end])
        place = low[i] + np.arange(len(i)) - np.repeat(begin[k:end] - begin[k], n[k:end])
        j = order[np.where(place < skip[i], place, place + resume[i] - skip[i])]
        parts.append((i, j, _common(a, b, i, j)))
        k = end
    # b's beginning has nothing before it, whatever its hash says
    more = np.flatnonzero((a == b[0]) & same & (pair == _after(b[:1])[0]))
    zero = np.zeros(len(more), np.int64)
    parts.append((more, zero, _common(a, b, more, zero)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def verify(a: np.ndarray, b: np.ndarray, width: int, num: int, den: int, places: _Places | None = None) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate passages of two shingle sequences: (start, length, start, length, similarity), in shingles.

    Maximal equal runs, over all occurrences of a shingle, are chained in
    order.  A shared shingle earns den - num and a place in a gap, on either
    side, costs num, so a stretch of a chain is similar enough if it earns
    what it costs; gaps may have two widths and more, which only stretches of
    ten widths could pay; where shingles repeat, the distinct ones decide.  Of each chain so many of the longest such stretches
    of at least width places are taken that they hold all others' runs.  All
    places of equal runs of at least width places are in passages.
    """
    if not len(a) or not len(b):
        return []
    i, j, size = _matches(a, b, places)
    if size.sum() < width * num // den:
        return []
    for _ in range(2):  # what one side leaves may thin out the other
        (keep, dense), (keep2, _) = _dense(i, size, len(a), width, num, den), _dense(j, size, len(b), width * num // den, num, den)
        keep &= keep2
        i, j, size = i[keep], j[keep], size[keep]
        if not len(i):
            return []
    keep = ~_inside(i, size, len(a), width)
    i, j, size = i[keep], j[keep], size[keep]
    found: list[tuple[int, int, int, int, float]] = []
    # only places that no wide run holds need chains, of the runs about them
    wide = size >= width
    dense[np.cumsum(np.bincount(i[wide], minlength=len(a) + 1) - np.bincount(i[wide] + size[wide], minlength=len(a) + 1))[: len(a)] > 0] = False
    total = np.concatenate([[0], np.cumsum(dense)])
    near = np.flatnonzero(total[np.minimum(i + size + 2 * width, len(a))] > total[np.maximum(i - 2 * width, 0)])
    if len(near) > 1:
        for chain in _chains(i[near], j[near], size[near], num, den, width):
            if dense[chain[0][0] : chain[0][-1] + chain[2][-1]].any():
                before = len(found)
                _stretches(a, b, chain, width, num, den, found)
                for f in found[before:]:
                    dense[f[0] : f[0] + f[1]] = False
    wide = np.flatnonzero(size >= width)
    first, last, done = i[wide], i[wide] + size[wide], 0
    for f in found:
        last[(f[0] <= first) & (last <= f[0] + f[1])] = 0
    for k in range(len(wide)):  # as few as hold the places of all
        if last[k] > done:
            reach = np.where(first <= max(first[k], done), last, 0)
            m = wide[int(reach.argmax())]
            found.append((int(i[m]), int(size[m]), int(j[m]), int(size[m]), 1.0))
            done = int(reach.max())
    return sorted(found)


def _dense(start: np.ndarray, size: np.ndarray, n: int, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks the runs with a place in some stretch of at least width places of which the runs' places, together, are a share of num / den; and such places.

    No other run can be in a passage: a stretch that earns its costs is one of these.
    """
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    covered = np.cumsum(edge[:n]) > 0
    total = np.concatenate([[0], np.cumsum(np.where(covered, den - num, -num))])
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    # the furthest end at which a stretch from each place on is dense
    far = n - np.searchsorted(ahead[::-1], total, side="left")
    first = np.flatnonzero(far - np.arange(n + 1) >= width)
    inside = np.cumsum(np.bincount(first, minlength=n + 2) - np.bincount(far[first], minlength=n + 2))[: n + 1] > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[start + size] > total[start], inside[:n]


def _inside(start: np.ndarray, size: np.ndarray, n: int, width: int) -> np.ndarray:
    """Marks the runs that stand inside a wide run, two widths from its ends at least (an end of the text has no further side).

    Repetitions within a text copied word by word; a stretch that reaches
    beyond the wide run has two widths of its own there.
    """
    wide = size >= width
    first, last = start[wide], start[wide] + size[wide]
    first, last = np.where(first > 0, first + 2 * width, 0), np.where(last < n, last - 2 * width, n)
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(last[by]) if len(by) else last
    at = np.searchsorted(first, start, side="right") - 1
    out = (at >= 0) & (reach[np.maximum(at, 0)] >= start + size) if len(by) else np.zeros(len(start), bool)
    whole = np.flatnonzero(size == n)
    out[whole[:1]] = False
    return out


def _links(i: np.ndarray, j: np.ndarray, size: np.ndarray, num: int, den: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earned at best up to each run's end, the run before it or -1, their overlap): runs chained in order, by i.

    best counts a chain from where it is best begun; a run is linked to the
    best before it even if that earns less than the gap costs, as long as what
    follows might pay for it.  Runs meet by the cells of `reach` places a side
    that their ends and beginnings are in, so that only neighbours on both
    sides are looked at.
    """
    n, earn = len(i), den - num
    back, over = [-1] * n, [0] * n
    last, last2 = i + size, j + size
    row = np.int64(j.max() // reach + 4)  # cells as one number
    here, end = ((i // reach) * row + j // reach).tolist(), ((last // reach) * row + last2 // reach).tolist()
    around = [c * int(row) + c2 for c in (-1, 0, 1) for c2 in (-1, 0, 1)]
    behind = (earn * np.cumsum(size[::-1])[::-1]).tolist()  # no chain from a run on earns more
    i_, j_, size_, last_, last2_, best = (x.tolist() for x in (i, j, size, last, last2, earn * size))
    cells: dict[int, list[int]] = {}
    for t in range(n):
        it, jt, st, top, at, cut_ = i_[t], j_[t], size_[t], -behind[t] - 1, -1, 0
        for c in around:
            for q in cells.get(here[t] + c, ()):
                if i_[q] < it and j_[q] < jt:
                    o = last_[q] - it
                    if last2_[q] - jt > o:
                        o = last2_[q] - jt
                    if o <= 0:
                        o, gain = 0, best[q] - num * (it + jt - last_[q] - last2_[q])
                    elif o < st:
                        gain = best[q] - earn * o - num * (it + jt + 2 * o - last_[q] - last2_[q])
                    else:
                        continue
                    if gain > top:
                        top, at, cut_ = gain, q, o
        if at >= 0:
            back[t], over[t] = at, cut_
            if top > 0:
                best[t] += top
        cells.setdefault(end[t], []).append(t)
    return np.array(best, np.int64), np.array(back), np.array(over)


def _chains(i: np.ndarray, j: np.ndarray, size: np.ndarray, num: int, den: int, width: int):
    """(place in a, place in b, length) of runs chained in order; a run that overlaps the one before it begins behind it.

    A chain for each run that none follows, the best first; where it joins one
    before, it goes on for four widths.  Chains too short for a passage are
    left out.
    """
    best, back, over = _links(i, j, size, num, den, 2 * width)
    size_ = size.tolist()
    leaf = np.ones(len(i), bool)
    leaf[back[back >= 0]] = False
    back_, i_, seen = back.tolist(), i.tolist(), [False] * len(i)
    leaves = np.flatnonzero(leaf & (back >= 0))
    for t in leaves[np.argsort(-best[leaves], kind="stable")].tolist():
        path, joined = [], None
        while t >= 0 and (joined is None or joined - i_[t] <= 4 * width):
            if seen[t] and joined is None:
                joined = i_[t]
            seen[t] = True
            path.append(t)
            t = back_[t]
        if i_[path[0]] + size_[path[0]] - i_[path[-1]] < width or sum(size_[k] for k in path) < width * num // den:
            continue
        k = np.array(path[::-1])
        o = over[k]
        o[0] = 0
        yield i[k] + o, j[k] + o, size[k] - o


class _Distinct:
    """Distinct values of two stretches, common to both and of either, while the stretches are cut at their ends."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        values, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.sides = [number[: len(x)], number[len(x) :]]
        self.counts = [np.bincount(side, minlength=len(values)) for side in self.sides]
        here, there = (c > 0 for c in self.counts)
        self.common, self.union = int((here & there).sum()), int((here | there).sum())

    def cut(self, n: int, m: int, end: int) -> None:
        """Takes n places off the first stretch and m off the second, at the beginning (end = 0) or the end (-1)."""
        for k, size in ((0, n), (1, m)):
            side = self.sides[k]
            gone, self.sides[k] = (side[:size], side[size:]) if end == 0 else (side[len(side) - size :], side[: len(side) - size])
            which, times = np.unique(gone, return_counts=True)
            self.counts[k][which] -= times
            which = which[self.counts[k][which] == 0]
            other = int((self.counts[1 - k][which] > 0).sum())
            self.common -= other
            self.union -= len(which) - other


def _stretches(a: np.ndarray, b: np.ndarray, chain: tuple, width: int, num: int, den: int, found: list) -> None:
    """Adds the stretches of a chain that are similar enough to found."""
    i, j, size = chain
    last, last2 = i + size, j + size
    cost = np.concatenate([[0], num * (i[1:] - last[:-1] + j[1:] - last2[:-1])])
    after = np.cumsum((den - num) * size - cost)
    before = after - (den - num) * size
    # the furthest run with which each run's stretch still earns its costs: the greatest of what follows decides
    top = np.maximum.accumulate(after[::-1])[::-1]
    far = len(top) - 1 - np.searchsorted(top[::-1], before)
    wide = last[far] - i >= width
    cur = 0
    while cur < len(i):
        starts = np.flatnonzero(wide[: cur + 1] & (far[: cur + 1] >= cur))
        if not len(starts):
            cur += 1
            continue
        p = int(starts[far[starts].argmax()])
        q = int(far[p])
        both = _Distinct(a[i[p] : last[q]], b[j[p] : last2[q]])
        while p <= q and last[q] - i[p] >= width:
            s, e, s2, e2 = int(i[p]), int(last[q]), int(j[p]), int(last2[q])
            if den * both.common >= num * both.union:
                if not any(f[0] <= s and e <= f[0] + f[1] for f in found):
                    found.append((s, e - s, s2, e2 - s2, both.common / both.union))
                break
            # the end whose run earns less over its gap goes
            if p < q and after[p] - before[p] - cost[p + 1] < after[q] - before[q] - cost[q]:
                p += 1
                both.cut(int(i[p]) - s, int(j[p]) - s2, 0)
            else:
                q -= 1
                if q >= p:
                    both.cut(e - int(last[q]), e2 - int(last2[q]), -1)
        cur = max(cur, q) + 1


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, gram: int = 5, num: int = 80, den: int = 100, hashes: int = 4, enough: int = 2, rounds: int = 2
) -> DataFrame:
    """Passages of at least min_words words that (nearly) stand in an earlier document too.

    Returns (id, start_word, n_words, start_byte, end_byte, match_id,
    match_start_word, match_n_words, similarity, text_hash): the passage in the later
    document and its match in the one with the smaller id; similarity is the
    Jaccard of their distinct gram-word shingles, at least num / den.  Words
    are runs of other than ASCII white space, A-Z lower-cased; bytes are of
    the UTF-8 text.  Passages repeated inside one document only are not
    reported.  Null, empty and short texts give no rows, nor do null ids; all
    texts of rows that repeat an id count as that document's, and text_hash
    (xxhash64) tells them apart; other columns are not read.

    Verbatim passages share their centre for every hash function; near ones
    for a share that grows with their similarity, so at 0.8 about one in forty
    is missed with 2 of 4 functions.
    """
    with scratch(docs.sparkSession):
        found = _found(docs, id_col, text_col, min_words - gram + 1, gram, num, den, hashes, enough, rounds)
    out = found.groupBy("id", "text_hash", "start_word", "n_words").agg(F.min(F.struct("match_id", "match_start_word", "match_n_words", "similarity", "start_byte", "end_byte")).alias("m"))
    return out.select(F.col("id").alias(id_col), "start_word", "n_words", "m.start_byte", "m.end_byte", "m.match_id", "m.match_start_word", "m.match_n_words", "m.similarity", "text_hash")


def _found(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int, num: int, den: int, hashes: int, enough: int, rounds: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    names = ["id", "key", "left", "centre", "right", "ctx"]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.ArrayType(T.LongType())), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[2:])])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    spark = docs.sparkSession
    path = new_path(spark, "shared")
    with scratch(spark):
        lists = written(base.mapInArrow(_windows(width, hashes, gram, names), schema), "windows")
        windows = lists.select("id", F.explode(F.arrays_zip("key", "left", "centre", "right", "ctx")).alias("w")).select("id", "w.*")
        shared = written_at(_met(windows), path)

    found = tried = None
    for turn in range(rounds + 1):
        pairs = _candidates(shared, width, enough if turn == 0 else 1)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["id", "match"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        new = kept(_verify_pairs(base, pairs, id_type, width, gram, num, den), f"passages{turn}")
        found = new if found is None else found.union(new)
        if turn == rounds:
            break
        open_keys = cut(_unsettled(shared, found))
        remove(spark, path)
        if open_keys.isEmpty():
            break
        path = new_path(spark, "shared")
        with scratch(spark):
            again = _contexts(open_keys) if turn + 1 < rounds else written(_exact_runs(base, open_keys, id_type, width, gram), "runs")
            shared = written_at(_met(again), path)
    return found


def _met(windows: DataFrame) -> DataFrame:
    """Windows of keys that several documents have, with the smallest of these (match)."""
    heads = windows.groupBy("key").agg(F.min("id").alias("match"), F.max("id").alias("last")).filter("match < last").select("key", "match")
    return windows.join(written(heads, "heads").hint("merge"), "key")  # a merge at every size, so that small corpora tell what large ones take


def _candidates(shared: DataFrame, width: int, enough: int) -> DataFrame:
    """Document pairs whose joined windows overlap by `width` for enough functions: (id, match).

    The interval join: a window pair allows any passage around the centre, so
    two pairs of windows agree when their intervals in the document overlap
    widely enough; counting windows over the cells of half a width that they
    cover finds agreement without comparing windows with each other.
    """
    shared = shared.filter("id > match")
    if enough <= 1:
        return shared.select("id", "match").distinct()
    half = max(1, width // 2)
    sizes = cut(shared.groupBy("id", "match").agg(F.count("*").alias("n")))
    many = F.col("n") > 8 * enough  # so many windows go to the verification at once
    few = shared.join(sizes.filter(~many & (F.col("n") >= enough)).select("id", "match"), ["id", "match"])
    cells = few.select("id", "match", "key", F.explode(F.expr(f"sequence(cast(ceil(left / {half}) as int), greatest(cast(ceil(left / {half}) as int), cast(floor((right + 1) / {half}) as int) - 1))")).alias("cell"))
    counted = cells.groupBy("id", "match", "cell").agg(F.count_distinct("key").alias("f")).filter(F.col("f") >= enough)
    return counted.select("id", "match").distinct().union(sizes.filter(many).select("id", "match"))


def _verify_pairs(base: DataFrame, pairs: DataFrame, id_type: T.DataType, width: int, gram: int, num: int, den: int) -> DataFrame:
    """The passages of document pairs.

    Pairs are ids alone: up to BROADCAST_IDS of them (counted) meet the later
    documents' texts at the scan; only texts with a match are shuffled to it.
    """
    small = pairs.count() <= BROADCAST_IDS
    hint = F.broadcast if small else (lambda df: df)
    # an earlier document with very many later ones meets them in as many tasks as they need
    parts = pairs.groupBy("match").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("parts"))
    pairs = cut(pairs.join(cut(parts), "match").select("id", "match", F.pmod(F.xxhash64("id"), "parts").alias("part")))
    later = base.join(hint(pairs), "id")
    first = base.join(hint(cut(pairs.select(F.col("match").alias("id"), "part").distinct())), "id").select(F.col("id").alias("match"), "part", F.col("text").alias("other"))
    both = later.join(first, ["match", "part"])
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("start_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())]
        + [T.StructField("match_id", id_type), T.StructField("match_start_word", T.IntegerType()), T.StructField("match_n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("text_hash", T.LongType())]
    )

    def run(batches):
        for t in batches:
            rows, last, b, places = [], None, None, None
            for lo, hi, w in W.batches_of(t.column(2), lower=True, limit=CACHED):
                grams = W.ngram_hashes(w.hashes(), gram)
                for k in range(lo, hi):
                    first, end = int(w.ptr[k - lo]), int(w.ptr[k - lo + 1])
                    raw = t.column(3)[k].as_buffer()
                    if last is None or not raw.equals(last):
                        last, b = raw, _shingles(raw, gram)[0]
                        places = _Places(b)
                    base = int(w.offsets[k - lo])
                    for s, n, s2, n2, sim in verify(grams[first : max(first, end - gram + 1)], b, width, num, den, places):
                        rows.append((t.column(0)[k].as_py(), s, n + gram - 1, int(w.starts[first + s]) - base, int(w.ends[first + s + n + gram - 2]) - base, t.column(1)[k].as_py(), s2, n2 + gram - 1, sim, t.column(4)[k].as_py()))
            doc = t.schema.field(0).type
            types = (doc, pa.int32(), pa.int32(), pa.int64(), pa.int64(), doc, pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], y) for k, y in enumerate(types)], names=schema.names)

    return both.select("id", "match", "text", "other", F.xxhash64("text")).mapInArrow(run, schema)


def _unsettled(shared: DataFrame, passages: DataFrame) -> DataFrame:
    """All windows of the keys that have a window in no verified passage of its pair: a settled member may hold what another looks for."""
    spans = passages.select("id", F.col("match_id").alias("match"), "start_word", (F.col("start_word") + F.col("n_words")).alias("end_word")).groupBy("id", "match").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    later = shared.filter("id > match").join(spans, ["id", "match"], "left")
    later = later.filter("spans is null or not exists(spans, s -> s.start_word <= centre and centre < s.end_word)")
    return shared.join(cut(later.select("key").distinct()), "key", "left_semi").drop("match")


def _exact_runs(base: DataFrame, windows: DataFrame, id_type: T.DataType, width: int, gram: int) -> DataFrame:
    """The windows keyed anew by every run of width shingles around their centre.

    Two texts with such a key share the whole run word by word, so the
    smallest document of a key settles all its members, and no shorter
    fragment can take the key.
    """
    lists = cut(windows.select("id", "left", "centre", "right").distinct().groupBy("id").agg(F.collect_list("left").alias("left"), F.collect_list("centre").alias("centre"), F.collect_list("right").alias("right")))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("left", "centre", "right", "ctx"))])

    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                grams = _shingles(t.column(1)[k].as_buffer(), gram)[0]
                left, centre, right = (t.column(n)[k].values.to_numpy() for n in (2, 3, 4))
                right = np.minimum(right, len(grams) - 1)  # another row's text with this id may be shorter
                first, last = np.maximum(left, centre - width + 1), np.minimum(centre, right - width + 1)
                at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(x, y + 1) for x, y in zip(first.tolist(), last.tolist()))]))
                if not len(at):
                    continue
                keys = W.run_hashes(grams, width)[at]
                place, zero = pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int32))
                ids = pa.array([t.column(0)[k].as_py()] * len(at), t.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(W.signed(keys)), place, place, pa.array((at + width - 1).astype(np.int32)), zero], names=schema.names)

    return _of(base, lists.select("id")).join(lists, "id").select("id", "text", "left", "centre", "right").mapInArrow(run, schema)


def _of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs with (or without) ids: up to BROADCAST_IDS of these (counted) meet the texts at the scan."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def _contexts(windows: DataFrame) -> DataFrame:
    """The windows again, keyed by their centre with what stands before it, and with what stands behind."""
    side = lambda name, bits: F.when(bits != 0, F.xxhash64("key", F.lit(name), bits))
    keys = F.array_compact(F.array(side("before", F.shiftrightunsigned("ctx", 16)), side("behind", F.col("ctx").bitwiseAND(F.lit(0xFFFF)))))
    return windows.select("id", F.explode(keys).alias("key"), "left", "centre", "right", "ctx")


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the reported passages cut out of their texts; all other columns and rows as they are, whatever their names."""
    mark, place = fresh("_hash", docs.columns), fresh("_spans", docs.columns)
    spans = passages.groupBy(id_col, F.col("text_hash").alias(mark)).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(place))

    def run(batches):
        for t in batches:
            k = t.schema.get_field_index(text_col)
            texts = []
            for text, spans in zip(t.column(k), t.column(t.num_columns - 1).to_pylist()):
                if not spans or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                raw, at, kept = text.as_buffer().to_pybytes(), 0, []
                for s in spans:
                    if s["start_byte"] > at:
                        kept.append(raw[at : s["start_byte"]])
                    at = max(at, s["end_byte"])
                texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
            arrays = [pa.array(texts, pa.string()) if n == k else t.column(n) for n in range(t.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=t.schema.names[:-1])

    spans = cut(spans)
    ids = cut(spans.select(id_col).distinct())
    some = _of(docs, ids).select(*docs.columns).withColumn(mark, F.xxhash64(text_col))  # only texts with a passage are shuffled
    made = some.join(spans, [id_col, mark], "left").select(*docs.columns, place).mapInArrow(run, docs.schema)
    return made.union(_of(docs, ids, "left_anti").select(*docs.columns))
