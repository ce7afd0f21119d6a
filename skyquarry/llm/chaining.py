"""Substring dedup by collinear chaining: fuzzy passages that several texts share.

Sampled word k-mers (the least hash of every few successive ones) are seeds.  An
occurrence of a seed is matched with the seed's first place, with the text before
and with the place before in its own text, never with all, so matches grow with the
occurrences.  Places of a text that are less than a passage apart count as one run,
so what repeats with a shorter period is not a repeat of itself.  The matches of two texts
are chained in order: a match adds its words and pays for the gap to the match
before it; a Fenwick tree over the places in the second text finds the best one
before.  The words around a chain are aligned between its matches and beyond its
ends, and passages that are long and alike enough remain.

A partner that holds only a piece of a passage may hide the others.  So what is not
yet a repeat is searched again, in two ways.  Two seeds that stand far apart in a text
are a seed together, which a text with a shorter piece doesn't have; such pairs are
matched, chained and aligned like single seeds, in rounds until nothing is found.
And for runs of equal words as long as a passage long k-mers, sampled so that each such
run has one, tell which places occur again; the whole runs there are compared by hash,
and all but the first of equal ones are repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.llm.graph import spread_join
from skyquarry.llm.text import Texts, as_texts, checkpointed, fresh, grams, mix, sliding_min, tabled, widened


@dataclass(frozen=True)
class Settings:
    words: int = 4
    #: Of each ``window`` successive k-mers at least one is a seed.
    window: int = 6
    #: A passage has at least so many words on either side, and at least this share of its aligned words match.
    least: int = 50
    alike: float = 0.8
    #: What a word of gap costs, in matched words.
    gap: float = 0.05
    #: Words around a chain that are aligned with it.
    margin: int = 100
    #: From a chain's first match to its last there are so many words at least.
    reach: int = 16
    #: Two seeds so many words apart, from and to, are a seed together in the second search.
    near: int = 24
    far: int = 72
    hold: int = 1 << 21


def seeds(texts: Texts, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text's number and word's number of the seeds of all texts long enough for a passage."""
    starts, ends, owner = texts.word_bounds()
    total = np.bincount(owner, minlength=texts.n)
    begin = np.concatenate([[0], np.cumsum(total)])
    long = total[owner] >= s.least
    at = np.flatnonzero(long)
    h, first = grams(texts.hash_spans(starts[at], ends[at], fold_case=True), owner[at], s.words)
    if len(h) < s.window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    bits = np.uint64(max(24, len(h).bit_length()))
    own = owner[at[first]]
    least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), s.window)
    least = least[own[: len(least)] == own[s.window - 1 :]]
    place = np.unique((least & np.uint64((1 << int(bits)) - 1)).astype(np.int64))
    return h[place], own[place], at[first[place]] - begin[own[place]]


def _linked(h: np.ndarray, node: np.ndarray, pos: np.ndarray, least: int) -> tuple[tuple, tuple]:
    """Of sorted occurrences: the first of each seed, and matches (a, b, place in a, place in b) of later ones with earlier ones.

    Places of one text that follow each other in less than ``least`` words would
    overlap as passages: they form a run, in which nothing is matched.  Partners are
    the seed's first place, a place in the text before and the place before in the
    same text.
    """
    if not len(h):
        return (h, node, pos), (node, node, pos, pos, h)
    at = np.arange(len(h))
    new = np.append(True, h[1:] != h[:-1])
    text = new | np.append(True, node[1:] != node[:-1])
    run = np.cumsum(text | np.append(True, pos[1:] - pos[:-1] >= least))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    begin = np.flatnonzero(text)[np.cumsum(text) - 1]
    later = np.flatnonzero(~new)
    second = at[begin > head]  # of the text before, the place of the same rank
    last = begin[begin[second] - 1]
    other = last + np.minimum(second - begin[second], begin[second] - last - 1)
    far = other != head[second]
    again = np.flatnonzero(~text & (at - 1 != head))
    a, b = np.concatenate([later, second[far], again]), np.concatenate([head[later], other[far], again - 1])
    apart = run[a] != run[b]
    a, b = a[apart], b[apart]
    return (h[new], node[new], pos[new]), (node[a], node[b], pos[a], pos[b], h[a])


_LINK = pa.schema([("route", pa.int64()), ("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("places", pa.int64())])


def _links(a, b, pa_, pb, h) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 1 << 18):
        j = slice(i, i + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(a[j] ^ b[j]), pa.array(h[j]), pa.array(a[j]), pa.array(b[j]), pa.array((pa_[j] << 32) | pb[j])], schema=_LINK)


def _ordered(h: np.ndarray, node: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (h, node, pos), and the places in it of seeds that occur twice or more: only these need more than h."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(h) else order
    own = order[again]
    order[again] = own[np.lexsort((pos[own], node[own], h[own]))]
    return order, again


def _settled(h: np.ndarray, node: np.ndarray, pos: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """Of a task's occurrences: the matches among them, and each seed's first one, without b, for the other tasks."""
    order, again = _ordered(h, node, pos)
    h, node, pos = h[order], node[order], pos[order]
    yield from _links(*_linked(h[again], node[again], pos[again], s.least)[1])
    new = np.append(True, h[1:] != h[:-1])
    h, node, pos = h[new], node[new], pos[new]
    for i in range(0, len(h), 1 << 18):
        j = slice(i, i + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(h[j]), pa.array(h[j]), pa.array(node[j]), pa.nulls(len(h[j]), pa.int64()), pa.array(pos[j])], schema=_LINK)


def _seed_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """What a task matches itself, and each seed's first occurrence in it for the others."""
    seen: set[int] = set()
    kept, held = [], 0

    for batch in batches:
        nodes = batch.column("node").to_numpy(False)
        for i, _, texts in as_texts(batch.column("text")):
            h, own, pos = seeds(texts, s)
            fresh = np.zeros(texts.n, bool)
            for k in range(texts.n):
                x = int(nodes[i + k])
                fresh[k] = x not in seen
                seen.add(x)
            ok = fresh[own]
            kept.append((h[ok].view(np.int64), nodes[i + own[ok]], pos[ok]))
            held += int(ok.sum())
        if held >= s.hold:
            yield from _settled(*(np.concatenate(x) for x in zip(*kept, strict=True)), s)
            kept, held = [], 0
    if held:
        yield from _settled(*(np.concatenate(x) for x in zip(*kept, strict=True)), s)


#: The upper bits of a hash by which first occurrences are packed.
BUCKET_BITS = 14


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LINK as arrays of numbers, which Spark neither takes apart nor sorts: first occurrences, which come in the order of their hash, by its upper bits, others as they come."""
    for batch in batches:
        plain = batch.column("b").is_valid()
        route, packs = [], []
        if plain.true_count:
            rows = np.stack([batch.filter(plain).column(c).to_numpy() for c in ("a", "b", "places", "h")])
            for i in range(0, rows.shape[1], 1 << 12):
                route.append(int(rows[0, i] ^ rows[1, i]))
                packs.append(rows[:, i : i + (1 << 12)].tobytes())
        kinds = [1] * len(packs)
        if plain.false_count:
            rows = np.stack([batch.filter(batch.column("b").is_null()).column(c).to_numpy() for c in ("h", "a", "places")])
            bucket = rows[0] >> (64 - BUCKET_BITS)
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                packs.append(rows[:, i:j].tobytes())
            route += bucket[edge[:-1]].tolist()
            kinds += [0] * (len(edge) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(route, pa.int64()), pa.array(packs, pa.binary())], names=["kind", "route", "pack"])


_PACKED = "kind int, route bigint, pack binary"


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _packed; rows sorted by (kind, route). Of first occurrences those of hashes that several tasks have, sorted by (h, a, places)."""

    def opened(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, a, p = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in packs], axis=1)
        order, again = _ordered(h, a, p)
        at = order[again]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(h[at]), pa.array(a[at]), pa.nulls(len(at), pa.int64()), pa.array(p[at])], schema=_LINK)

    now, kept = None, []
    for batch in batches:
        for kind, route, pack in zip(*(batch.column(c).to_pylist() for c in ("kind", "route", "pack")), strict=True):
            if kept and (kind or route != now):
                yield from opened(kept)
                kept = []
            if kind:
                a, b, p, h = np.frombuffer(pack, np.int64).reshape(4, -1)
                yield pa.RecordBatch.from_arrays([pa.array(a ^ b), pa.array(h), pa.array(a), pa.array(b), pa.array(p)], schema=_LINK)
            else:
                now = route
                kept.append(pack)
    if kept:
        yield from opened(kept)


def _match_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Matches: those that come as such, and those between tasks' first occurrences; rows sorted by h."""
    rest = None
    for batch in batches:
        plain = batch.column("b").is_valid()
        if plain.true_count:
            yield batch.filter(plain).select(["a", "b", "places", "h"])
            batch = batch.filter(batch.column("b").is_null())
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(False) for c in ("h", "a", "places")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # at most one row a task for the seed that may go on
        for out in _links(*_linked(*(x[:cut] for x in now), s.least)[1]):
            yield out.select(["a", "b", "places", "h"])
        rest = [x[cut:] for x in now]
    if rest is not None:
        for out in _links(*_linked(*rest, s.least)[1]):
            yield out.select(["a", "b", "places", "h"])


def _by_text(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[np.ndarray]]:
    """Columns, the first of which is the node, of whole texts at a time; rows sorted by node."""
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(False).astype(np.int64) for c in columns]
        if rest is not None:
            now = [np.concatenate(c) for c in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last text may go on
        if cut:
            yield [c[:cut] for c in now]
        rest = [c[cut:] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def _left_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The seeds (kind 1, crowded ones 2; x: hash) that lie in no span (kind 0; x: its end); rows (node, kind, pos, x) sorted by (node, kind, pos).

    Of a run of one seed in a text, as in _linked, the first place.
    """
    for node, kind, pos, x in _by_text(batches, "node", "kind", "pos", "x"):
        rank = np.cumsum(np.append(0, node[1:] != node[:-1]))
        place, cut = (rank << 32) | pos, kind == 0
        ok = ~cut
        if cut.any():
            of = np.searchsorted(place[cut], place, side="right") - 1
            ok &= (of < 0) | (rank[cut][of] != rank) | (pos + s.words > x[cut][of])
        at = np.flatnonzero(ok)
        at = at[np.lexsort((place[at], x[at]))]
        again = (x[at[1:]] == x[at[:-1]]) & (place[at[1:]] - place[at[:-1]] < s.least)  # places of two texts are further apart
        at = np.sort(at[np.append(True, ~again)]) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (node, pos, x, kind - 1)], names=["node", "pos", "x", "crowded"])


#: Words of 64 bits that tell, by a hash, which texts hold a seed.
LANES = 4


def _pair_rows(batches: Iterable[pa.RecordBatch], s: Settings, told: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of seeds that stand s.near to s.far words apart, one of them crowded, matched as in _settled; rows (node, pos, x, crowded) sorted by (node, pos).

    A pair is two seeds, one at either place.  told: rows also have ``fresh`` (1
    where the seed's places are others than in the search before; a pair needs one
    such seed) and the bits of the other places' texts (a pair without a common bit
    is nowhere else).
    """
    kept, held = [], 0
    more = ["fresh", *(f"other{k}" for k in range(LANES))] if told else []
    for node, pos, x, crowded, *rest in _by_text(batches, "node", "pos", "x", "crowded", *more):
        place, h, crowded = (np.cumsum(np.append(0, node[1:] != node[:-1])) << 32) | pos, x.view(np.uint64), crowded > 0
        for k in range(1, s.far + 1):
            apart = place[k:] - place[:-k]
            if not (apart <= s.far).any():
                break
            i = np.flatnonzero((apart >= s.near) & (apart <= s.far) & (crowded[k:] | crowded[:-k]))
            if told:
                i = i[(rest[0][i] | rest[0][i + k]) > 0]
                i = i[np.any([bits[i] & bits[i + k] for bits in rest[1:]], axis=0)]
            both = mix(h[i] + (h[i + k] << np.uint64(1)) + np.uint64(1))
            for end, at in ((0, i), (1, i + k)):
                kept.append(((both ^ np.uint64(end)).view(np.int64), node[at], pos[at]))
            held += 2 * len(i)
            if held >= s.hold:
                yield from _settled(*(np.concatenate(c) for c in zip(*kept, strict=True)), s)
                kept, held = [], 0
    if held:
        yield from _settled(*(np.concatenate(c) for c in zip(*kept, strict=True)), s)


def chain(x: list[int], y: list[int], s: Settings) -> list[list[int]]:
    """Chains of matches (x rising, then y) as lists of their numbers, best first; each match is in one at most."""
    n = len(x)
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, came = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches at one place can't follow each other
            best, r = (-1e18, -1), ranks[y[j]] - 1
            while r:
                if tree[r] > best:
                    best = tree[r]
                r &= r - 1
            gain = best[0] - s.gap * (x[j] + y[j])
            score[j] = s.words + max(0.0, gain)
            came[j] = best[1] if gain > 0 else -1
            j += 1
        for m in range(i, j):
            value, r = (score[m] + s.gap * (x[m] + y[m]), m), ranks[y[m]]
            while r <= size:
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        i = j
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: -score[m]):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = came[m]
        if path:
            out.append(path[::-1])
    return out


def _chains(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(a, b, matches): chains that may belong to a passage; rows sorted by (a, b, places)."""
    rest = None

    def settle(a, b, p):
        rows = []
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        cut = np.append(np.flatnonzero(new), len(a))
        size = np.diff(cut)
        x, y = p >> 32, p & 0xFFFFFFFF
        for i in np.flatnonzero(size >= 2).tolist():
            u, v = cut[i], cut[i + 1]
            if x[v - 1] - x[u] < s.reach:
                continue
            px, py = x[u:v], y[u:v]
            if (np.diff(px) > 0).all() and (py - px == py[0] - px[0]).all() and (np.diff(px) * 2 * s.gap < s.words).all():
                found = [range(v - u)]
            else:
                found = chain(px.tolist(), py.tolist(), s)
            for c in found:
                if len(c) > 1 and min(px[c[-1]] - px[c[0]], py[c[-1]] - py[c[0]]) >= s.reach:
                    c = np.fromiter(c, np.int64)
                    rows.append((int(a[u]), int(b[u]), np.stack([px[c], py[c]]).astype(np.int32).tobytes(), int(px[c[0]]), int(px[c[-1]]), int(py[c[0]]), int(py[c[-1]])))
        if rows:
            types = [pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "b", "matches", "a0", "a1", "b0", "b1"])

    for batch in batches:
        now = [batch.column(c).to_numpy(False) for c in ("a", "b", "places")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])  # bounded by the seeds of one text
        cut = len(same) - int(same.sum())
        yield from settle(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield from settle(*rest)


def _word_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The words (as hashes) that chains ask for, and every text's number of words and mark; a text comes before its requests.

    Of different texts with one node only the first is measured, and its mark says which.
    """
    now, words = None, np.zeros(0, np.uint32)
    for batch in batches:
        rows = []
        node, kind = batch.column("node").to_pylist(), batch.column("kind").to_pylist()
        ids, lo, hi = (batch.column(c).to_pylist() for c in ("id", "lo", "hi"))
        matches, texts = batch.column("matches"), batch.column("text")
        for k in range(batch.num_rows):
            if kind[k] == 0:
                if now == node[k]:
                    continue
                now, words = node[k], np.zeros(0, np.uint32)
                for _, _, t in as_texts(texts.slice(k, 1)):
                    a, b, _ = t.word_bounds()
                    words = (t.hash_spans(a, b, fold_case=True) >> np.uint64(32)).astype(np.uint32)
                rows.append((now, ids[k], 0, None, len(words), None, now))
            elif now == node[k]:
                a = max(0, lo[k] - s.margin)
                rows.append((ids[k], ids[k], kind[k], words[a : hi[k] + s.words + s.margin].tobytes(), a, matches[k].as_py(), now))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["route", "id", "side", "words", "at", "matches", "node"])


def _edits(a: np.ndarray, b: np.ndarray, most: int = 20) -> int:
    """Edit distance of two word sequences, or most + 1 if it is larger: within a band of that width it is exact."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far, x, y = most + 1, a.tolist(), b.tolist()
    row = {j: j for j in range(min(most, len(y)) + 1)}
    for i, u in enumerate(x, 1):
        lo, hi = max(0, i - most), min(len(y), i + most)
        now = {}
        for j in range(lo, hi + 1):
            if j == 0:
                now[j] = i
            else:
                now[j] = min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (u != y[j - 1]))
        row = now
    return min(far, row[len(y)])


def _extension(same: np.ndarray) -> tuple[int, int]:
    """How far to go along equal (or not) words, and the mismatches in it: best score, given up 20 below it."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -4))
    top = np.maximum.accumulate(np.maximum(score, 0))
    over = np.flatnonzero(score < top - 20)
    if len(over):
        score = score[: over[0]]
    best = int(score.argmax())
    if score[best] <= 0:
        return 0, 0
    return best + 1, int((~same[: best + 1]).sum())


def _parts(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, edits: np.ndarray, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """The passages between any two matches of a row, with the words alike beyond them, that lie in no other one."""

    def back(i: int) -> tuple[int, int]:
        k = min(x[i], y[i])
        return _extension((a[x[i] - k : x[i]] == b[y[i] - k : y[i]])[::-1])

    def on(i: int) -> tuple[int, int]:
        u, v = x[i] + s.words, y[i] + s.words
        k = max(0, min(len(a) - u, len(b) - v))
        return _extension(a[u : u + k] == b[v : v + k])

    total = np.cumsum(edits)
    before, after = np.array([back(0)]), np.array([on(len(x) - 1)])
    out, done = [], -1
    for whole in (True, False):  # mostly the row is one passage
        n = 1 if whole else len(x)
        firsts, lasts = np.arange(n), np.arange(len(x) - n, len(x))
        if not whole:
            before, after = np.array([back(i) for i in range(n)]), np.array([on(i) for i in range(n)])
        a1, b1 = x[lasts] + s.words + after[:, 0], y[lasts] + s.words + after[:, 0]
        for i in firsts.tolist():
            a0, b0 = x[i] - before[i, 0], y[i] - before[i, 0]
            wrong = total[lasts] - total[i] + before[i, 1] + after[:, 1]
            longest = np.maximum(a1 - a0, b1 - b0)
            good = (lasts >= i) & (np.minimum(a1 - a0, b1 - b0) >= s.least) & (longest - wrong >= s.alike * longest)
            k = np.flatnonzero(good)
            if len(k) and k[-1] > done:
                done = int(k[-1])
                out.append((int(a0), int(a1[done]), int(b0), int(b1[done]), int(wrong[done])))
        if out:
            break
    return out or _stretched(a, b, x, y, int(total[-1] - total[0]), s)


def _stretched(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, wrong: int, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """The best passage that reaches further on both sides than the words beyond pay for, as long as the whole is alike enough: it may begin and end near an edit."""
    u, v = int(x[-1]) + s.words, int(y[-1]) + s.words
    k, m = min(int(x[0]), int(y[0]), s.least), max(0, min(len(a) - u, len(b) - v, s.least))
    short, long = min(u - x[0], v - y[0]), max(u - x[0], v - y[0])
    if short + k + m < s.least or long - wrong < s.alike * long - 0.2 * (k + m):
        return []
    sides = []
    for same in ((a[x[0] - k : x[0]] == b[y[0] - k : y[0]])[::-1], a[u : u + m] == b[v : v + m]):
        n = np.flatnonzero(np.append(True, same))  # lengths that end with an equal word
        sides.append((n, np.append(0, np.cumsum(~same))[n]))
    (i, p), (j, q) = sides
    size, bad = long + i[:, None] + j[None, :], wrong + p[:, None] + q[None, :]
    good = (short + i[:, None] + j[None, :] >= s.least) & (size - bad >= s.alike * size)
    if not good.any():
        return []
    r, c = np.unravel_index(np.where(good, size - 5 * bad, -(1 << 40)).argmax(), good.shape)
    return [(int(x[0] - i[r]), int(u + j[c]), int(y[0] - i[r]), int(v + j[c]), int(bad[r, c]))]


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """(begin, stop in a, begin, stop in b, edits) of the passages along a chain of matches at x, y."""
    n = len(x)
    edits = np.zeros(n, np.int64)  # before each match, since the one before
    dx, dy = np.diff(x), np.diff(y)
    straight = dx == dy
    wrong = np.zeros(len(a) + 1, np.int64)
    for d in np.unique(y - x).tolist():
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        wrong[:] = 0
        wrong[lo + 1 : hi + 1] = a[lo:hi] != b[lo + d : hi + d]
        total = np.cumsum(wrong)
        own = np.flatnonzero(straight & (y[1:] - x[1:] == d)) + 1
        edits[own] = total[x[own]] - total[x[own - 1]]
    for i in (np.flatnonzero(~straight) + 1).tolist():
        p, q = min(x[i - 1] + s.words, x[i]), min(y[i - 1] + s.words, y[i])
        u, v = a[p : x[i]], b[q : y[i]]
        edits[i] = _edits(u, v)
    out, i = [], 0
    breaks = np.flatnonzero(edits > 20)  # nothing alike between: passages of their own
    for stop in [*breaks.tolist(), n]:
        if stop > i:
            out += _parts(a, b, x[i:stop], y[i:stop], edits[i:stop], s)
        i = stop
    return out


_SPAN = pa.schema([("node", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("partner", pa.int64()), ("repeat", pa.bool_()), ("mark", pa.int64())])


def _span_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Spans of passages on both sides; a row without partner has a text's number of words and its mark. Rows sorted by (id, side)."""
    first = None
    for batch in batches:
        rows = []
        cols = {c: batch.column(c) for c in batch.schema.names}
        ids, sides, at, node = (cols[c].to_pylist() for c in ("id", "side", "at", "node"))
        for k in range(batch.num_rows):
            if sides[k] == 0:
                rows.append((node[k], 0, at[k], None, False, ids[k]))
            elif sides[k] == 1:
                first = (ids[k], node[k], at[k], np.frombuffer(cols["words"][k].as_py(), np.uint32))
            elif first is not None and first[0] == ids[k]:
                other, first = first, None
                words = np.frombuffer(cols["words"][k].as_py(), np.uint32)
                x, y = np.frombuffer(cols["matches"][k].as_py(), np.int32).astype(np.int64).reshape(2, -1)
                for a0, a1, b0, b1, _ in align(other[3], words, x - other[2], y - at[k], s):
                    rows.append((other[1], other[2] + a0, other[2] + a1, node[k], True, None))
                    rows.append((node[k], at[k] + b0, at[k] + b1, other[1], False, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPAN.types, strict=True)], schema=_SPAN)


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts, each once."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for x in batch.column("node").to_pylist():
            fresh.append(x not in seen)
            seen.add(x)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _noded(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("node", F.xxhash64("text")).withColumn("mark", F.xxhash64("text", F.lit(1)))


def _packed_matches(rows: DataFrame, s: Settings) -> DataFrame:
    """_matches of packed rows."""
    return rows.repartition("route").sortWithinPartitions("kind", "route").mapInArrow(lambda b: _match_rows(_unpacked(b), s), "a bigint, b bigint, places bigint, h bigint")


def _matches(rows: DataFrame, s: Settings) -> DataFrame:
    """Matches (a, b, places, h) from what _settled yields in tasks."""
    return rows.repartition("route").sortWithinPartitions("h", "a", "places").mapInArrow(lambda b: _match_rows(b, s), "a bigint, b bigint, places bigint, h bigint")


def _chained(matches: DataFrame, s: Settings) -> DataFrame:
    schema = "a bigint, b bigint, matches binary, a0 bigint, a1 bigint, b0 bigint, b1 bigint"
    found = matches.select("a", "b", "places").repartition("a", "b").sortWithinPartitions("a", "b", "places").mapInArrow(lambda b: _chains(b, s), schema)
    return tabled(found.withColumn("id", F.monotonically_increasing_id()))  # numbers are fixed by the table


def _spans(texts: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Spans of the passages along the chains found, and the texts' numbers of words; see passages."""
    none = F.lit(None)
    wanted = texts.mapInArrow(_distinct, texts.schema).select("node", F.lit(0).alias("kind"), F.col("mark").alias("id"), none.cast("bigint").alias("lo"), none.cast("bigint").alias("hi"), none.cast("binary").alias("matches"), "text")
    for side, node, lo, hi in ((1, "a", "a0", "a1"), (2, "b", "b0", "b1")):
        own = F.col("matches") if side == 2 else none.cast("binary")
        wanted = wanted.unionAll(found.select(F.col(node).alias("node"), F.lit(side).alias("kind"), "id", F.col(lo).alias("lo"), F.col(hi).alias("hi"), own.alias("matches"), none.cast("string").alias("text")))
    words = wanted.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(
        lambda b: _word_rows(b, s), "route bigint, id bigint, side int, words binary, at bigint, matches binary, node bigint"
    )
    spans = words.repartition("route").sortWithinPartitions("id", "side")
    return spans.mapInArrow(lambda b: _span_rows(b, s), "node bigint, start bigint, stop bigint, partner bigint, repeat boolean, mark bigint")


def _told(left: DataFrame, before: DataFrame | None, crowded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """left's seeds that several texts have, with what _pair_rows wants to be told, and each seed's number of places (x, n).

    A text is a bit by its hash.  A place's own bit counts only if another place of
    the seed has it too, so a pair that occurs twice has a common bit at both places.
    before: the numbers in the search before.  crowded(x, crowded): where left itself
    doesn't say it.
    """
    slot = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(64 * LANES)).cast("int")
    marked = left.withColumn("slot", slot)
    slots = marked.groupBy("x", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    bit = lambda k, ok: F.when(ok & F.col("slot").between(64 * k, 64 * k + 63), F.expr(f"shiftleft(1L, slot - {64 * k})")).otherwise(F.lit(0).cast("bigint"))
    masks = [F.bit_or(bit(k, ok)).alias(f"{name}{k}") for k in range(LANES) for name, ok in (("all", F.lit(True)), ("twice", F.col("n") > 1))]
    several = slots.groupBy("x").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *masks).where("lo < hi").drop("lo", "hi")
    if crowded is not None:
        several = several.join(crowded, "x")
    several = tabled(several if before is None else several.join(before.withColumnRenamed("n", "was"), "x", "left"))
    fresh = F.lit(1) if before is None else F.when(F.col("n") == F.col("was"), 0).otherwise(1)
    other = [F.col(f"all{k}").bitwiseAND(F.bitwise_not(bit(k, F.lit(True)))).bitwiseOR(F.col(f"twice{k}")).alias(f"other{k}") for k in range(LANES)]
    joined = spread_join(marked, several, ["x"], ["node", "pos"])
    return tabled(joined.select("node", "pos", "x", "crowded", fresh.cast("bigint").alias("fresh"), *other)), several.select("x", "n")


_LEFT = "node bigint, pos bigint, x bigint, crowded bigint"


def _uncut(places: DataFrame, spans: DataFrame, s: Settings) -> DataFrame:
    """places(node, pos, x) that the repeats among spans leave, as _left_rows gives them (but for crowded)."""
    cuts = merged(spans).where("repeat").select("node", F.lit(0).cast("bigint").alias("kind"), F.col("start").alias("pos"), F.col("stop").alias("x"))
    rows = places.select("node", F.lit(1).cast("bigint").alias("kind"), "pos", "x").unionAll(cuts).repartition("node").sortWithinPartitions("node", "kind", "pos")
    return tabled(rows.mapInArrow(lambda b: _left_rows(b, s), _LEFT).drop("crowded"))


def _left(places: DataFrame, spans: DataFrame, s: Settings) -> DataFrame:
    """The seeds that the repeats among spans leave, with what _pair_rows wants to be told.

    places(node, pos, x): the seeds that occur twice or more; crowded (1 or 0) are
    those of three places or more.
    """
    crowded = places.groupBy("x").agg((F.count(F.lit(1)) > 2).cast("bigint").alias("crowded"))
    return _told(_uncut(places, spans, s), None, crowded)[0]


def _held(left: list[tuple[DataFrame, DataFrame | None]], by: DataFrame, key: str) -> DataFrame:
    """The rows of left, a table and what later searches told anew of which seeds, that have a key in by; only the last are fresh."""
    out = None
    for k, (told, seeds) in enumerate(left):
        rows = told.join(by, key, "left_semi")
        if k + 1 < len(left):
            rows = rows.withColumn("fresh", F.lit(0).cast("bigint"))
        rows = rows.select(*left[0][0].columns)
        out = rows if out is None else out.join(seeds, "x", "left_anti").select(*rows.columns).unionAll(rows)
    return out


def _left_again(left: list[tuple[DataFrame, DataFrame | None]], spans: DataFrame, more: DataFrame, s: Settings) -> tuple[list[tuple[DataFrame, DataFrame | None]], DataFrame]:
    """left without the places that the repeats among more take, and the texts (node) where a seed is fresh.

    Only texts with such a repeat lose places, and only the seeds that lost one
    (fresh) are told anew; all others stay as they are and are not written again.
    spans: all of them, more's included, as a seed may lie across two that touch.
    """
    texts = tabled(more.where("repeat").select("node").distinct())
    some = _held(left, texts, "node").select("node", "pos", "x")
    gone = tabled(some.join(_uncut(some, spans.join(texts, "node", "left_semi"), s), ["node", "pos", "x"], "left_anti"))
    seeds = tabled(gone.select("x").distinct())
    rest = _held(left, seeds, "x").select("node", "pos", "x", "crowded").join(gone, ["node", "pos", "x"], "left_anti")
    told = _told(rest, None)[0]
    return [*left, (told, seeds)], tabled(told.select("node").distinct())


def _hidden(texts: DataFrame, left: list[tuple[DataFrame, DataFrame | None]], fresh: DataFrame | None, s: Settings, before: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Spans of the passages that pairs of distant seeds find in left, and all matches of pairs so far.

    Only pairs with a crowded seed, and of which several texts are left, may have been
    hidden.  fresh, before: the texts where a seed has lost a place since, and the
    matches of all earlier searches.  A pair of which no place has gone since matches
    as it did, so only the others are matched again; where they match, the earlier
    matches of the two texts are chained with them, and where none does there are no
    spans (None).
    """
    rows = left[0][0] if fresh is None else _held(left, fresh, "node")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the same in each search, as partners depend on what is in a task
    links = rows.repartition(tasks, "node").sortWithinPartitions("node", "pos").mapInArrow(lambda b: _pair_rows(b, s, True), "route bigint, h bigint, a bigint, b bigint, places bigint")
    matches = tabled(_matches(links, s).select("a", "b", "places").distinct())
    if matches.isEmpty():
        return None, matches
    now = matches
    if before is not None:
        now = matches.unionAll(before.join(matches.select("a", "b").distinct(), ["a", "b"], "left_semi")).distinct()
        matches = before.unionAll(matches)
    found = _chained(now, s)
    some = tabled(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return checkpointed(_spans(texts.join(some, "node", "left_semi"), found, s).where("partner is not null")), matches


def _gram_rows(batches: Iterable[pa.RecordBatch], s: Settings, whole: bool) -> Iterator[pa.RecordBatch]:
    """Hash, node and place of word k-mers; rows sorted by (node, kind), a text (kind 1) after its spans.

    whole: all runs of s.least words around the long k-mers at the spans' starts.
    Otherwise: sampled long k-mers, at least one in every run of s.least words that
    has no word in a span.
    """
    long = replace(s, words=s.least - s.window + 1)
    spans: dict[int, list[tuple[int, int]]] = {}
    done = None
    for batch in batches:
        texts = []
        kind, node, lo, hi = (batch.column(c).to_pylist() for c in ("kind", "node", "lo", "hi"))
        for k in range(batch.num_rows):
            if kind[k] == 0:
                spans.setdefault(node[k], []).append((lo[k], hi[k]))
            elif node[k] != done:
                done = node[k]
                texts.append(k)
        for i, _, t in as_texts(batch.column("text").take(pa.array(texts, pa.int64()))):
            ids = [node[k] for k in texts[i : i + t.n]]
            if whole:
                starts, ends, owner = t.word_bounds()
                begin = np.searchsorted(owner, np.arange(t.n))
                wanted = np.zeros(len(starts) + 1, bool)
                for k, x in enumerate(ids):
                    at = np.array([a for a, _ in spans.get(x, [])], np.int64)
                    at = (at[:, None] - np.arange(s.window)).ravel()
                    wanted[begin[k] + at[at >= 0]] = True
                h, first = grams(t.hash_spans(starts, ends, fold_case=True), owner, s.least)
                h, first = h[wanted[first]], first[wanted[first]]
                own = owner[first]
                pos = first - begin[own]
            else:
                h, own, pos = seeds(t, long)
                ok = np.ones(len(h), bool)
                edge = np.searchsorted(own, np.arange(t.n + 1))
                for k, x in enumerate(ids):
                    if x in spans:
                        a, b = np.array(sorted(spans[x]), np.int64).T
                        j = slice(edge[k], edge[k + 1])
                        of = np.searchsorted(a, pos[j], side="right") - 1
                        ok[j] = (of < 0) | (b[of] < pos[j] + long.words)
                h, own, pos = h[ok], own[ok], pos[ok]
            if len(h):
                nodes = np.array(ids, np.int64)[own]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(nodes), pa.array(pos.astype(np.int64))], names=["h", "node", "pos"])
        spans = {x: v for x, v in spans.items() if x == node[-1]} if batch.num_rows and node[-1] != done else {}


def _once_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows of _LINK from a task's k-mers (h, node, pos): places of those that it has twice, and of each k-mer one, without b, for the others (places: twice the place, and 1 if it is also among the former)."""
    kept, held = [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        h, node, pos = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.argsort(h)
        h, node, pos = h[order], node[order], pos[order]
        same = h[1:] == h[:-1]
        new, again = np.append(True, ~same), np.append(False, same) | np.append(same, False)
        for at, b in ((np.flatnonzero(again), node), (np.flatnonzero(new), None)):
            for i in range(0, len(at), 1 << 18):
                j = at[i : i + (1 << 18)]
                other, place = (pa.array(node[j]), pos[j]) if b is not None else (pa.nulls(len(j), pa.int64()), 2 * pos[j] + again[j])
                yield pa.RecordBatch.from_arrays([pa.array(h[j]), pa.array(h[j]), pa.array(node[j]), other, pa.array(place)], schema=_LINK)

    for batch in batches:
        kept.append([batch.column(c).to_numpy(False) for c in ("h", "node", "pos")])
        held += batch.num_rows
        if held >= s.hold:
            yield from settle()
            kept, held = [], 0
    if held:
        yield from settle()


def _twice_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, pos of the k-mers that occur twice or more, from the rows of _once_rows after _unpacked."""
    for batch in batches:
        node, place = batch.column("a"), batch.column("places").to_numpy()
        if batch.column("b").null_count:
            single = place & 1 == 0
            node, place = node.filter(pa.array(single)), place[single] >> 1
        yield pa.RecordBatch.from_arrays([node, pa.array(place)], names=["node", "pos"])


def _equal_spans(runs: DataFrame, s: Settings) -> DataFrame:
    """Spans of equal runs (h, node, pos) of s.least words: each with the first one, which a frequent run's others reach in many tasks.

    Places of one text that follow each other in less than s.least words are one run, as in _linked.
    """
    before = F.lag("pos").over(Window.partitionBy("h", "node").orderBy("pos"))
    runs = checkpointed(runs.withColumn("before", before).where(F.col("before").isNull() | (F.col("pos") - F.col("before") >= s.least)).drop("before"))
    heads = runs.groupBy("h").agg(F.min(F.struct("node", "pos")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "head")
    pairs = spread_join(runs, heads, ["h"], ["node", "pos"]).where("node <> head.node or pos <> head.pos")
    span = lambda node, pos, other, repeat: F.struct(F.col(node).alias("node"), F.col(pos).alias("start"), (F.col(pos) + s.least).alias("stop"), F.col(other).alias("partner"), F.lit(repeat).alias("repeat"))
    both = pairs.select(F.explode(F.array(span("node", "pos", "head.node", True), span("head.node", "head.pos", "node", False))).alias("x"))
    return both.select("x.*", F.lit(None).cast("bigint").alias("mark"))


def _exact(texts: DataFrame, spans: DataFrame, s: Settings) -> DataFrame:
    """Spans of the exact passages that the repeats among spans leave."""
    schema = "h bigint, node bigint, pos bigint"
    none = F.lit(None)

    def grams_of(texts: DataFrame, places: DataFrame, whole: bool) -> DataFrame:
        run, kind = (lambda b: _gram_rows(b, s, True), schema) if whole else (lambda b: _packed(_once_rows(_gram_rows(b, s, False), s)), _PACKED)
        own = texts.mapInArrow(_distinct, texts.schema).select("node", F.lit(1).alias("kind"), none.cast("bigint").alias("lo"), none.cast("bigint").alias("hi"), "text")
        rows = places.select("node", F.lit(0).alias("kind"), "lo", "hi", none.cast("string").alias("text")).unionAll(own)
        return rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(run, kind)

    cuts = merged(spans).where("repeat").select("node", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    sampled = grams_of(texts, cuts, False).repartition("route").sortWithinPartitions("kind", "route")
    places = checkpointed(sampled.mapInArrow(lambda b: _twice_rows(_unpacked(b)), "node bigint, pos bigint").select("node", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
    some = texts.join(places.select("node").distinct(), "node", "left_semi")
    return _equal_spans(grams_of(some, places, True), s)


def passages(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(node, start, stop, partner, repeat): spans of words in each distinct text (node: its hash) that another one shares.

    Texts are ordered by their hash: of two, the later one's span is the repeat.  A
    row without partner has a text's number of words as ``stop``.

    Runs of s.least equal words are all found; passages that are only alike are
    missed where too few seeds are left in them.
    """
    texts = _noded(docs).select("node", "mark", "text")
    rows = texts.select("node", "text").mapInArrow(lambda b: _packed(_seed_rows(b, s)), _PACKED)
    matches = tabled(_packed_matches(rows, s))
    place = lambda node, pos: F.struct(F.col(node).alias("node"), pos.alias("pos"), F.col("h").alias("x"))
    ends = F.array(place("a", F.shiftrightunsigned("places", 32)), place("b", F.col("places").bitwiseAND(0xFFFFFFFF)))
    places = tabled(matches.select(F.explode(ends).alias("p")).select("p.*").groupBy("node", "pos").agg(F.min("x").alias("x")))
    spans = checkpointed(_spans(texts, _chained(matches, s), s))
    left, fresh, matches = [(_left(places, spans, s), None)], None, None
    while True:
        more, matches = _hidden(texts, left, fresh, s, matches)
        if more is None or more.where("repeat").isEmpty():
            break
        spans = spans.unionAll(more)
        left, fresh = _left_again(left, spans, more, s)
    return spans.unionAll(_exact(texts, spans, s))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of one node and kind united where they overlap or touch; partner is the least."""
    distinct = spans.where("partner is not null").groupBy("node", "repeat", "start", "stop").agg(F.min("partner").alias("partner"))
    order = Window.partitionBy("node", "repeat").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    united = distinct.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return united.groupBy("node", "repeat", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("partner").alias("partner")).drop("run")


def _sizes(spans: DataFrame) -> DataFrame:
    """node, mark and n_words of each text that was measured."""
    return spans.where("partner is null").groupBy("node").agg(F.max(F.struct("stop", "mark")).alias("x")).select("node", F.col("x.mark").alias("mark"), F.col("x.stop").alias("n_words"))


def shared_passages(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, start_word, end_word, n_words (of the text), other_doc_id, repeat: spans of words shared with other documents.

    Both sides of a shared passage are reported; ``repeat`` tells the occurrences
    to remove, so that one is left.  Equal texts of s.least words or more are
    shared as a whole and their least doc_id is the one to keep; other spans are
    given for every copy.  Rows that repeat both doc_id and text count as one
    document.  A text is known by two 64-bit hashes; one that shares the first but
    not the second with a text that was measured has no spans.  Null, empty and
    short texts share nothing; null doc_ids are kept only where there is no other.
    Other columns are not looked at.
    """
    spans = checkpointed(passages(docs, s))
    rows = _noded(docs).select("doc_id", "node", "mark").distinct()
    texts = checkpointed(rows.groupBy("node", "mark").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).join(_sizes(spans), ["node", "mark"]))
    partner = texts.select(F.col("node").alias("partner"), F.col("least").alias("other_doc_id"))
    fuzzy = merged(spans).join(partner, "partner").groupBy("node").agg(F.collect_list(F.struct("start", "stop", "other_doc_id", "repeat")).alias("spans"))
    facts = texts.where((F.col("copies") > 1) & (F.col("n_words") >= s.least)).select("node", F.lit(True).alias("copied")).join(fuzzy, "node", "full").join(texts, "node")
    own = spread_join(rows, facts, ["node", "mark"], ["doc_id"])
    whole = F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("stop"), F.col("least").alias("other_doc_id"), (~F.col("doc_id").eqNullSafe(F.col("least"))).alias("repeat"))
    every = F.concat(F.when(F.col("copied"), F.array(whole)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,other_doc_id:bigint,repeat:boolean>>")), F.coalesce("spans", F.array()))
    found = own.select("doc_id", "n_words", F.explode(every).alias("x"))
    return found.select("doc_id", F.col("x.start").alias("start_word"), F.col("x.stop").alias("end_word"), "n_words", "x.other_doc_id", "x.repeat")


def cut_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs, all columns, without the repeats of shared_passages: one occurrence of each passage is left.

    A span goes with the white space after it.  Documents of which no word is left
    go as a whole; ``n_chars``, where there is such a column, is counted anew for
    texts that were cut.  Of equal texts of s.least words or more the document with
    the least doc_id stays; rows that repeat both doc_id and text, null ids
    included, are one document and stay or go together.  Null, empty and short
    texts stay as they are; extra columns are carried along, whatever their names.
    """
    spans = checkpointed(passages(docs, s))
    names = docs.columns
    node, mark, found, copied, least, total = fresh(docs, "node", "mark", "cuts", "copied", "least", "total")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(node, F.xxhash64(text)).withColumn(mark, F.xxhash64(text, F.lit(1)))
    sizes = _sizes(spans).select(F.col("node").alias(node), F.col("mark").alias(mark), "n_words")
    cuts = merged(spans).where("repeat").groupBy(F.col("node").alias(node)).agg(F.collect_list(F.struct("start", "stop")).alias(found)).join(sizes.select(node, mark), node)
    copies = marked.groupBy(node, mark).agg(F.min("doc_id").alias(least), F.count(F.lit(1)).alias(total)).where(F.col(total) > 1)
    copies = copies.join(sizes.where(F.col("n_words") >= s.least).select(node, mark), [node, mark]).select(node, mark, least, F.lit(True).alias(copied))
    joined = spread_join(marked, cuts.join(copies, [node, mark], "full"), [node, mark], ["doc_id"], "left")
    joined = joined.where(F.col(copied).isNull() | F.col("doc_id").eqNullSafe(F.col(least))).select(*names, found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(found)
            batch = batch.select(names)
            hit = np.flatnonzero(cut.is_valid().to_numpy(False))
            if not len(hit):
                yield batch
                continue
            keep = np.ones(batch.num_rows, bool)
            column = batch.column("text").to_pylist()
            counts = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for k in hit.tolist():
                for _, _, t in as_texts(pa.array([column[k]], pa.string())):
                    starts, ends, _ = t.word_bounds()
                    edges = np.append(starts, len(t.data))
                    gone = np.zeros(len(t.data), bool)
                    left = len(starts)
                    for c in cut[k].as_py():
                        gone[edges[c["start"]] : edges[c["stop"]]] = True
                        left -= c["stop"] - c["start"]
                    column[k] = t.data[~gone].tobytes().decode()
                    keep[k] = left > 0
                if counts is not None:
                    counts[k] = len(column[k])
            batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(column, batch.schema.field("text").type))
            if counts is not None:
                batch = batch.set_column(names.index("n_chars"), batch.schema.field("n_chars"), pa.array(counts, batch.schema.field("n_chars").type))
            yield batch.filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return shared_passages(widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
