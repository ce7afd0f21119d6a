"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every string of ``length`` bytes holds a minimal hash among its ``seed``-byte
pieces; the piece (the anchor) is the same in equal strings, at the same place.  So
only suffixes at anchors need sorting, and of these only those whose anchor occurs
elsewhere too.  Each task sorts the suffixes of its texts into runs, one for each
target, and front-codes them: a suffix is sent as the length of the prefix it
shares with the one before, and the rest.  A target merges its runs with a loser
tree whose nodes keep the prefix length a loser shares with the string that beat
it, so a prefix once known equal is never compared again.  The merge yields the
common prefix of all neighbours; a string that starts ``o`` bytes before its anchor
occurs twice if two suffixes share ``length - o`` bytes from the anchor and ``o``
bytes before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.graph import spread_join
from skyquarry.llm.text import _INVERSE, as_texts, checkpointed, mix, powers, sliding_min, widened


@dataclass(frozen=True)
class Settings:
    length: int = 200
    seed: int = 64
    #: Anchors, and suffixes, that a task holds before it passes them on.
    hold: int = 1 << 19
    hold_suffixes: int = 1 << 15

    def __post_init__(self):
        if not 0 < self.seed <= self.length < 256:
            raise ValueError("a length has to fit a byte, and a seed has to fit a length")


_PLACE_BITS = 24


def anchors(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last start of the strings whose anchor it is.

    A string's anchor is its piece with the least leading hash bits, of equal ones
    the leftmost: that depends on the string alone.  Long texts go in stretches.
    """
    out, step = [], 1 << (_PLACE_BITS - 1)
    width, bits = s.length - s.seed + 1, np.uint64(_PLACE_BITS)
    for begin in range(0, max(len(data) - s.length + 1, 0), step):
        part = data[begin : begin + step + s.length - 1]
        n = len(part)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
        h = mix((prefix[s.seed :] - prefix[: -s.seed]) * powers(n + 1, _INVERSE)[: n - s.seed + 1])
        least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), width)
        starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        place = (least[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        out.append((h[place], place + begin, starts + begin, np.append(starts[1:], len(least)) - 1 + begin))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (place << 16) | ((place - lo) << 8) | (place - hi)


def _anchor_rows(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(route, h, m1, at). Anchors that this task itself finds twice are settled: h is null, and one row without m1 tells the others."""
    seen: set[tuple[int, int]] = set()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, m, at = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(h, kind="stable")
        h, m, at = h[order], m[order], at[order]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        known = np.bincount(group)[group] > 1
        told = h[new & known].view(np.int64)
        n = len(told)
        for a in range(0, len(h) + n, 1 << 18):
            i = np.arange(a, min(a + (1 << 18), len(h) + n))
            own = i < len(h)
            j = np.minimum(i, len(h) - 1)
            value = np.where(own, h[j].view(np.int64), told[np.maximum(i - len(h), 0)] if n else 0)
            settled = own & known[j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(settled, m[j], value)),
                    pa.array(value, mask=settled),
                    pa.array(m[j], mask=~own),
                    pa.array(at[j], mask=~own),
                ],
                names=["route", "h", "m1", "at"],
            )

    for batch in batches:
        m1, m2 = batch.column("m1").to_pylist(), batch.column("m2").to_pylist()
        for i, _, texts in as_texts(batch.column("text")):
            for k in range(texts.n):
                mark = (m1[i + k], m2[i + k])
                data = texts.data[texts.offsets[k] : texts.offsets[k + 1]]
                if len(data) < s.length or mark in seen:
                    continue
                seen.add(mark)
                h, place, lo, hi = anchors(data, s)
                kept.append((h, np.full(len(h), mark[0], np.int64), _pack(place, lo, hi)))
                held += len(h)
        if held >= s.hold:
            yield from flush()
            kept, held = [], 0
    if held:
        yield from flush()


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m1, at) of settled rows and of rows whose hash another row has too; rows come sorted by h."""
    rest: tuple[np.ndarray, ...] | None = None

    def settle(h, m, at, told):
        new = np.append(True, h[1:] != h[:-1])
        same = np.append(False, ~new[1:] & (m[1:] == m[:-1]) & (at[1:] == at[:-1]) & ~told[1:] & ~told[:-1])  # one text in two tasks
        group = np.cumsum(new) - 1
        size = np.bincount(group, (~same).astype(float) + told)
        good = (size[group] > 1) & ~told & ~same
        return pa.RecordBatch.from_arrays([pa.array(m[good]), pa.array(at[good])], names=["m1", "at"])

    for batch in batches:
        h = batch.column("h")
        settled = h.is_null()
        if settled.true_count:
            yield batch.select(["m1", "at"]).filter(settled)
            batch = batch.filter(h.is_valid())
        if not batch.num_rows:
            continue
        told = batch.column("m1").is_null().to_numpy(False)
        now = tuple(batch.column(c).fill_null(0).to_numpy(False) for c in ("h", "m1", "at")) + (told,)
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last hash may go on; a hash that fills a batch waits
        if cut:
            yield settle(*(x[:cut] for x in now))
        rest = tuple(x[cut:] for x in now)
    if rest is not None and len(rest[0]):
        yield settle(*rest)


def _suffix_runs(batches: Iterable[pa.RecordBatch], s: Settings, targets: int) -> Iterator[pa.RecordBatch]:
    """(target, run, m1, m2, begin, stop): front-coded runs, and intervals of suffixes that occur twice in this task, context and all."""
    width, left = s.length, s.length - s.seed
    seen: set[tuple[int, int]] = set()
    both, info, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows, meta = np.concatenate(both), np.concatenate(info)
        order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows, meta = rows[order], meta[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        double = np.bincount(group)[group] > 1
        m1, m2, place, back, ahead = (meta[double][:, c] for c in range(5))
        if len(m1):
            yield pa.RecordBatch.from_arrays(
                [pa.array((m1.view(np.uint64) % np.uint64(targets)).astype(np.int32)), pa.nulls(len(m1), pa.binary()), pa.array(m1), pa.array(m2), pa.array(place - back), pa.array(place - ahead + s.length)],
                names=["target", "run", "m1", "m2", "begin", "stop"],
            )
        rows, meta = rows[first], np.column_stack([meta[first], double[first]])
        head = rows[:, : s.seed].astype(np.uint64)
        target = (mix((head * powers(s.seed)[None, :]).sum(axis=1, dtype=np.uint64)) % np.uint64(targets)).astype(np.int32)
        for t in np.unique(target).tolist():
            at = np.flatnonzero(target == t)
            own, m = rows[at], meta[at]
            right, before = own[:, :width], own[:, width:]
            size = (right > 0).sum(axis=1)
            differ = right[1:] != right[:-1]
            shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), size[:-1]))
            columns = np.arange(width)[None, :]
            sent = right[(columns >= shared[:, None]) & (columns < size[:, None])].tobytes()
            back = (before > 0).sum(axis=1)
            run = pickle.dumps(
                (shared.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), sent, back.astype(np.uint8).tobytes(), before[before > 0].tobytes(), m[:, :3].tobytes(), m[:, 3:].astype(np.uint8).tobytes())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([run], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], names=["target", "run", "m1", "m2", "begin", "stop"]
            )

    for batch in batches:
        m1, m2, packs = batch.column("m1").to_pylist(), batch.column("m2").to_pylist(), batch.column("places")
        for i, _, texts in as_texts(batch.column("text")):
            for k in range(texts.n):
                mark = (m1[i + k], m2[i + k])
                if mark in seen:
                    continue
                seen.add(mark)
                data = texts.data[texts.offsets[k] : texts.offsets[k + 1]] + np.uint8(1)  # 0 marks the end
                at = packs[i + k].values.to_numpy(zero_copy_only=False)
                place, back, ahead = at >> 16, (at >> 8) & 255, at & 255
                ok = (place - back >= 0) & (place - ahead + s.length <= len(data))  # else another text of the same mark
                place, back, ahead = place[ok], back[ok], ahead[ok]
                padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(width, np.uint8)])
                columns = np.arange(width)[None, :]
                right = padded[left + place[:, None] + columns]
                right[columns >= (s.length - ahead)[:, None]] = 0
                columns = np.arange(left)[None, :]
                before = padded[left + place[:, None] - 1 - columns]
                before[columns >= back[:, None]] = 0
                both.append(np.concatenate([right, before], axis=1))
                info.append(np.column_stack([np.full(len(place), mark[0]), np.full(len(place), mark[1]), place, back, ahead]).astype(np.int64))
                held += len(place)
                if held >= s.hold_suffixes:
                    yield from flush()
                    both, info, held = [], [], 0
    if held:
        yield from flush()


class Run:
    """A front-coded sorted run, read one suffix after the other."""

    def __init__(self, raw: bytes):
        shared, size, sent, back, before, ids, steps = pickle.loads(raw)
        self.shared, self.size, self.sent = shared, size, sent
        self.n, self.back, self.before = len(shared), np.frombuffer(back, np.uint8), np.frombuffer(before, np.uint8)
        self.ids, self.steps = np.frombuffer(ids, np.int64).reshape(-1, 3), np.frombuffer(steps, np.uint8).reshape(-1, 3)
        self.i, self.at, self.key = -1, 0, b""
        self.next()

    def next(self) -> int:
        """Moves on; the prefix shared with the suffix before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared = self.shared[self.i]
        end = self.at + self.size[self.i] - shared
        self.key = self.key[:shared] + self.sent[self.at : end]
        self.at = end
        return shared


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y))
    d = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - (d.bit_length() + 7) // 8


def merge(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """(run, number in it, prefix shared with the suffix before) of all suffixes in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    loser, prefix = [-1] * k, [-1] * k  # of each inner node: who lost there, and the prefix it shares with the winner
    out: tuple[list[int], list[int], list[int]] = ([], [], [])

    def duel(a: int, pa_: int, b: int, pb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, the prefix it shares with the winner); prefixes before: with the last string put out."""
        if pa_ > pb:
            return a, pa_, b, pb
        if pb > pa_:
            return b, pb, a, pa_
        if pa_ < 0:
            return a, pa_, b, pb
        x, y = runs[a].key, runs[b].key
        c = common(x, y, pa_)
        if x[c : c + 1] <= y[c : c + 1]:
            return a, pa_, b, c
        return b, pb, a, c

    level = [(j, 0 if j < len(runs) and runs[j].n else -1) for j in range(k)]
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, pw, lost, pl = duel(*level[i], *level[i + 1])
            loser[node + i // 2], prefix[node + i // 2] = lost, pl
            up.append((w, pw))
        level = up
    w, pw = level[0]
    which, number, shared = out
    while pw >= 0:
        which.append(w)
        number.append(runs[w].i)
        shared.append(pw)
        now, pn = w, runs[w].next()
        node = (k + w) // 2
        while node:
            now, pn, loser[node], prefix[node] = duel(now, pn, loser[node], prefix[node])
            node //= 2
        w, pw = now, pn
    return out


def repeated_starts(runs: list[Run], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(m1, m2, begin, stop) of what the suffixes of these runs repeat."""
    which, number, shared = (np.array(x, np.int64) for x in merge(runs))
    n = len(which)
    base = np.cumsum([0, *(r.n for r in runs)])
    order = base[which] + number
    ids = np.concatenate([r.ids for r in runs])[order]
    steps = np.concatenate([r.steps for r in runs])[order].astype(np.int64)
    back, ahead, settled = steps[:, 0], steps[:, 1], steps[:, 2] > 0
    most = s.length - s.seed
    before = np.zeros((n, max(most, 1)), np.uint8)
    size = np.concatenate([r.back for r in runs])
    columns = np.arange(before.shape[1])[None, :]
    before[columns < size[:, None]] = np.concatenate([r.before for r in runs])
    before = np.ascontiguousarray(before[order])
    by_left = np.argsort(before.view(f"S{before.shape[1]}").ravel(), kind="stable")
    sorted_left = before[by_left]
    differ = sorted_left[1:] != sorted_left[:-1]
    left_shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), before.shape[1])) if n else np.zeros(0, np.int64)
    marked = np.zeros((n, most + 2), bool)
    left_class = np.empty(n, np.int64)
    for o in range(most + 1):
        part = np.flatnonzero((ahead <= o) & (o <= back))
        if len(part) < 2:
            continue
        right_class = np.cumsum(shared < s.length - o)
        left_class[by_left] = np.cumsum(left_shared < o)
        key = right_class[part] * (n + 1) + left_class[part]
        at = np.argsort(key, kind="stable")
        same = key[at][1:] == key[at][:-1]
        marked[part[at[1:][same]], o] = True
        marked[part[at[:-1][same]], o] = True
    marked[settled] = False  # already told by the task that found both
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), marked.astype(np.int8)], axis=1), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    place = ids[row, 2]
    return ids[row, 0], ids[row, 1], place - after + 1, place - first + s.length


def _merged(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    runs = []
    for batch in batches:
        plain = batch.column("run").is_null()
        if plain.true_count:
            yield batch.select(["m1", "m2", "begin", "stop"]).filter(plain)
        runs += [Run(x) for x in batch.column("run").drop_null().to_pylist()]
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in repeated_starts(runs, s)], names=["m1", "m2", "begin", "stop"])


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts, each once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        fresh = []
        for mark in zip(batch.column("m1").to_pylist(), batch.column("m2").to_pylist(), strict=True):
            fresh.append(mark not in seen)
            seen.add(mark)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m1, m2, n_bytes, n_removed, n_spans, kept) of each text."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        rows = []
        m1, m2, found = batch.column("m1").to_pylist(), batch.column("m2").to_pylist(), batch.column("found")
        for i, _, texts in as_texts(batch.column("text")):
            for k in range(texts.n):
                mark = (m1[i + k], m2[i + k])
                if mark in seen:
                    continue
                seen.add(mark)
                data = texts.data[texts.offsets[k] : texts.offsets[k + 1]]
                spans = found[i + k].values.flatten()
                delta = np.zeros(len(data) + 1, np.int64)
                np.add.at(delta, spans[0].to_numpy(zero_copy_only=False), 1)
                np.add.at(delta, spans[1].to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(delta)[:-1] > 0
                rows.append((*mark, len(data), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])), data[~gone].tobytes()))
        if rows:
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["m1", "m2", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(m1, m2, begin, stop): byte intervals of repeated strings in each distinct text (its two 64-bit hashes name it).

    Texts that occur several times are treated as one here; see remove_repeats.
    """
    spark = docs.sparkSession
    targets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _marked(docs).select("m1", "m2", "text")
    found = texts.mapInArrow(lambda b: _anchor_rows(b, s), "route bigint, h bigint, m1 bigint, at bigint")
    found = found.repartition("route").sortWithinPartitions("h", "m1", "at").mapInArrow(_repeated, "m1 bigint, at bigint")
    places = found.groupBy("m1").agg(F.collect_set("at").alias("places"))
    with_places = texts.mapInArrow(_distinct, texts.schema).repartition("m1").join(places, "m1").select("m1", "m2", "text", "places")
    runs = with_places.mapInArrow(lambda b: _suffix_runs(b, s, targets), "target int, run binary, m1 bigint, m2 bigint, begin bigint, stop bigint")
    return runs.repartitionById(targets, F.col("target")).mapInArrow(lambda b: _merged(b, s), "m1 bigint, m2 bigint, begin bigint, stop bigint")


def _marked(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("m1"), F.xxhash64("text", F.lit(1)).alias("m2"), "text")


def remove_repeats(docs: DataFrame, s: Settings = Settings(), digest: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; null if all remain) of every row.

    A byte goes if a string of s.length bytes that covers it also starts elsewhere,
    in the same text or another; matches never cross texts.  A text of that length
    or more that occurs in several rows is removed from all of them.  digest: not
    the bytes but their SHA-256, of every row.  Null text: empty, nothing to
    remove.  Equal or null doc_id play no part; other columns are not looked at.
    """
    spans = checkpointed(repeated_spans(docs, s))
    marked = _marked(docs)
    by_text = spans.groupBy("m1", "m2").agg(F.collect_list(F.struct("begin", "stop")).alias("found"))
    texts = marked.select("m1", "m2", "text").mapInArrow(_distinct, "m1 bigint, m2 bigint, text string").repartition("m1", "m2")
    cut = texts.join(by_text, ["m1", "m2"]).select("m1", "m2", "text", "found").mapInArrow(_cut, "m1 bigint, m2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    cut = cut.select("m1", "m2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept") if digest else "kept")
    own = [F.sha2(F.col("text").cast("binary"), 256).alias("own")] if digest else []
    rows = marked.select("doc_id", "m1", "m2", F.octet_length("text").cast("bigint").alias("n_bytes"), *own)
    out = spread_join(rows, cut, ["m1", "m2"], ["doc_id"], "left", count="copies")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= s.length)
    nothing = F.sha2(F.lit(b""), 256) if digest else F.lit(b"")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept", "own") if digest else F.col("kept")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM h WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
u AS (SELECT h.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
      FROM t JOIN h ON h.doc_id = t.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN u ON u.doc_id = h.doc_id
"""
