"""Packing: token streams cut into windows by an order-preserving dynamic programme.

The documents of a partition, in their order, form one stream of ids.  A window
holds at most ``size`` ids.  Cuts are allowed after a document (free), after a
sentence (a small penalty) and at a grid of further places (a larger one); the cost of a plan is its padding plus its penalties.  With
``key[j] = cost[j] + position[j]`` the recurrence is
``key[j] = min(key[i] : position[j] - position[i] <= size) + size + penalty[j]``,
a sliding minimum that a monotone queue gives in constant time a cut.
"""

from __future__ import annotations

import functools
import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.text import widened


@dataclass(frozen=True)
class Costs:
    """In units of one padded id."""

    sentence: int = 1
    anywhere: int = 4
    #: Cuts elsewhere than after a document or sentence lie this many ids apart.
    step: int = 16


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: outside these ranges, Unicode versions may differ between libraries on what is a letter.
_UNSETTLED = re.compile("[^\x00-\u024f\u0370-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


def unsettled(text: str) -> bool:
    """Does the text hold characters that only the tokenizer's own library can be trusted to class?"""
    return not text.isascii() and _UNSETTLED.search(text) is not None


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file, by the faster tiktoken where the file allows."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        to_byte = byte_characters()
        table = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (max([*table.values(), *self.special.values()]) + 1)
        for t, i in table.items():
            self.tokens[i] = t
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        fit = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        fit = fit and None not in made and made == sorted(made) and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
        fit = fit and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        if fit:
            #: Fixed value: the published pattern of this kind of pre-tokenizer.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
            plain = encoding.encode_ordinary

            def encode(text: str) -> list[int]:
                if unsettled(text):
                    return library.encode(text, add_special_tokens=False).ids
                if split is None or not any(x in text for x in self.special):
                    return plain(text)
                return [i for part in split.split(text) for i in ([self.special[part]] if part in self.special else plain(part))]

            self.encode: Callable[[str], list[int]] = encode
        else:
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids

    def sentence_ends(self) -> np.ndarray:
        """Of each id: does a sentence or line end with it?"""
        return np.array([bool(re.search(rb"[.!?][\"')\]]*\s*$|\n", t)) for t in self.tokens])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[ByteBpe, np.ndarray]:
    own = ByteBpe(path)
    return own, own.sentence_ends()


def plan_cuts(total: int, ends: np.ndarray, sentences: np.ndarray, size: int, costs: Costs, last: bool) -> np.ndarray:
    """Cut positions from 0: to ``total`` if last, else to the best start for what is still to come.

    ends, sentences: rising positions after documents and after sentences.
    """
    positions = np.unique(np.concatenate([ends, sentences, np.arange(0, total, costs.step), *([[total]] if last else [])])).astype(np.int64)
    positions = positions[(positions > 0) & (positions <= total)]
    penalty = np.full(len(positions), costs.anywhere)
    penalty[np.isin(positions, sentences)] = costs.sentence
    penalty[np.isin(positions, ends)] = 0
    pos, extra = [0, *positions.tolist()], [0, *penalty.tolist()]
    came = [0] * len(pos)
    queue = deque([(0, 0, 0)])  # (key, position, number), keys and positions rising
    push, pop, drop = queue.append, queue.pop, queue.popleft
    for j in range(1, len(pos)):
        p = pos[j]
        while queue[0][1] < p - size:
            drop()
        key, _, came[j] = queue[0]
        key += size + extra[j]
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, j))
    j = len(pos) - 1
    if not last:
        while queue[0][1] < total - size:
            drop()
        j = queue[0][2]
    cuts = [pos[j]]
    while j:
        j = came[j]
        cuts.append(pos[j])
    return np.array(cuts[::-1])


class _Stream:
    """The ids not yet packed, of documents in order."""

    def __init__(self, size: int, costs: Costs, is_end: np.ndarray, first_sequence: int):
        self.size, self.costs, self.is_end, self.sequence = size, costs, is_end, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids before the first kept here, kept ids, ids in all)
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.waiting += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the windows that are settled."""
        if not self.docs:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        cuts = plan_cuts(len(ids), ends, np.flatnonzero(self.is_end[ids]) + 1, self.size, self.costs, last)
        stop = int(cuts[-1])
        edges = np.union1d(cuts, ends[ends < stop])
        a, b = edges[:-1], edges[1:]
        doc, window = np.searchsorted(ends, a, side="right"), np.searchsorted(cuts, a, side="right") - 1
        raw, begins, offset = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], ends[:-1]]), a - cuts[window]
        out = []
        for x, y, d, w, o in zip(a.tolist(), b.tolist(), doc.tolist(), window.tolist(), offset.tolist(), strict=True):
            doc_id, before, _, n = self.docs[d]
            out.append((doc_id, before + x - int(begins[d]), y - x, bytes(raw[4 * x : 4 * y]), n, self.sequence + w, o))
        self.sequence += len(cuts) - 1
        first = int(np.searchsorted(ends, stop, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, before, kept, n = rest[0]
            skip = stop - int(begins[first])
            rest[0] = (doc_id, before + skip, kept[skip:], n)
        self.docs, self.waiting = rest, len(ids) - stop
        return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, costs: Costs = Costs(), hold: int = 1 << 19) -> DataFrame:  # noqa: B008
    """Pieces of documents in sequences of at most ``size`` ids: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    A document is its text's ids, then end_id; null and empty texts are end_id
    alone.  Each partition of docs is a stream of its own, in its rows' order: no
    shuffle, and at most one partly filled sequence a partition.  sequence_id holds
    the partition in its upper bits, so a task run again gives the same ids.
    ``hold`` ids are planned at once, so memory doesn't depend on the partition.
    Rows with equal or null doc_id are documents of their own; other columns are
    not looked at.  path must be readable where tasks run.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, is_end = tokenizer(path)
        stream = _Stream(size, costs, is_end, TaskContext.get().partitionId() << 33)

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            if rows := stream.flush(last):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = own.encode(texts[i].as_py() or "")
                ids.append(end_id)
                stream.add(doc_id, np.array(ids, np.uint32))
                if stream.waiting >= hold:
                    yield from emit(False)
        yield from emit(True)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, SCHEMA)


def pieces(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return pieces(pack(docs, vocabulary("byte_bpe_50k.json")))
