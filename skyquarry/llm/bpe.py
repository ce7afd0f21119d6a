"""BPE with forced boundaries.

A merge can only make a token of the vocabulary, so two neighbouring symbols that
no token holds side by side are never joined: the place between them is certain
to be a cut.  A word is split there first; its fragments are encoded on their own
and concatenated.  Words recur, so most come from a bounded memory.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyquarry.llm.packing import byte_characters, unsettled, vocabulary
from skyquarry.llm.text import widened


class Memory(dict):
    """A bounded memo of a function in two generations: the older goes when the younger is full.  Only what ``keeps`` says is kept."""

    def __init__(self, make, most: int, keeps=lambda key: True):
        super().__init__()
        self.make, self.most, self.keeps, self.older = make, most, keeps, {}

    def __missing__(self, key):
        if not self.keeps(key):
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """Encoder and decoder for a BPE file with word ends, as the tokenizers library runs it."""

    def __init__(self, path: str, consistent: bool = False, most: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = byte_characters()
        self.letters = {b: c for c, b in self.bytes.items()}
        names = self.ids | self.special
        self.tokens = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert") or level.get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a vocabulary of this kind")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")").split
        self.inner, self.final = self.joined()
        self.fast = self.quick() if consistent else None
        self.known = Memory(self.encode_word, most, lambda word: len(word) <= 64)  # long ones hardly recur, and would fill a worker
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def symbols(self, token: str) -> list[str]:
        """The single symbols of a token; the last one carries the word end if the token does."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def joined(self) -> tuple[bytearray, bytearray]:
        """Of each two bytes (a * 256 + b): does a token hold them side by side, inside a word and at its end?"""
        to_byte = {c: b for b, c in self.letters.items()}
        inner, final = bytearray(65536), bytearray(65536)
        for token in self.ids:
            symbols = self.symbols(token)
            for a, b in zip(symbols, symbols[1:], strict=False):
                if a in to_byte and b[0] in to_byte:
                    (inner if len(b) == 1 else final)[to_byte[a] * 256 + to_byte[b[0]]] = 1
        return inner, final

    def fragments_of(self, word: bytes) -> list[bytes]:
        """A word's bytes, split at its forced boundaries."""
        inner, n = self.inner, len(word)
        cuts = [i for i in range(1, n - 1) if not inner[word[i - 1] << 8 | word[i]]]
        if n > 1 and not self.final[word[-2] << 8 | word[-1]]:
            cuts.append(n - 1)
        if not cuts:
            return [word]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, n], strict=True)]

    def merge(self, fragment: bytes, ends: bool) -> list[int]:
        """Ids of one fragment: the best-ranked neighbours are joined, leftmost first, until none can be."""
        symbols, ranks = [self.letters[b] for b in fragment], self.ranks
        if ends:
            symbols[-1] += self.suffix
        none = len(ranks)
        while len(symbols) > 1:
            order = [ranks.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return [self.ids[s] for s in symbols]

    def consistent(self) -> bool:
        """Does every merged token's own string merge to just that token? Then merging by token rank is the same."""
        to_byte = {c: b for b, c in self.letters.items()}
        for a, b in self.ranks:
            token = a + b
            ends = token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            if self.merge(bytes(to_byte[c] for c in body), ends) != [self.ids[token]]:
                return False
        return True

    def quick(self):
        """A merger by rank; byte 255, which UTF-8 never has, stands for the word end."""
        import tiktoken

        to_byte = {c: b for b, c in self.letters.items()}
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        self.of_rank = {b: self.ids[c] for b, c in self.letters.items()} | {256 + b: self.ids[self.letters[b] + self.suffix] for b in range(255)}
        for rank, (a, b) in enumerate(self.ranks):
            token = a + b
            ends = token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            key = bytes(to_byte[c] for c in body) + b"\xff" * ends
            if key not in ranks:
                ranks[key] = 512 + rank
                self.of_rank[512 + rank] = self.ids[token]
        return tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_word(self, word: str) -> bytes:
        return self.encode_bytes(word.encode())

    def encode_bytes(self, word: bytes) -> bytes:
        parts = self.fragments_of(word)
        last = len(parts) - 1
        if self.fast:
            of = self.of_rank
            ids = [of[r] for i, p in enumerate(parts) for r in self.fast(p + b"\xff" if i == last else p)]
        else:
            ids = [x for i, p in enumerate(parts) for x in self.merge(p, i == last)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def normalize(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter: no final form
                return "".join(map(str.lower, text))
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        if not any(s in text for s in self.special):
            if unsettled(text):  # the library says what is a word, here too each is cut and merged by itself
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return b"".join(self.encode_bytes(bytes(map(self.bytes.__getitem__, w))) for w, _ in words)
            return b"".join(map(self.known.__getitem__, self.words(self.normalize(text))))
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self.encode(p) for p in self.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, consistent: bool) -> WordBpe:
    return WordBpe(path, consistent)


@functools.lru_cache(maxsize=2)
def is_consistent(path: str) -> bool:
    return WordBpe(path).consistent()


def encode(docs: DataFrame, path: str, decode: bool = True, rows: int = 256) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32 bits) and, if asked for, decoded: the text that the ids read back to.

    Row by row without a shuffle; whole texts.  Null and empty texts: no ids and an
    empty text.  Ties, repeated rows and other columns play no part.  path must be
    readable where tasks run.  Output batches hold ``rows`` rows.
    """
    consistent = is_consistent(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, consistent)
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
                arrays = [batch.column("doc_id"), pa.array(ids, pa.binary())]
                if decode:
                    arrays.append(pa.array(map(own.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    schema = "doc_id bigint, ids binary" + ", decoded string" * decode
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = encode(docs, vocabulary("word_bpe_49k.json"))
    return out.select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
