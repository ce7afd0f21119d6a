"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose signal exceeds a cutoff.  The labelled documents of
a stratum are split by a hash of their text.  One part chooses: for each signal the
cutoff that gains most, and the order of the signals.  The other part, which
nothing has looked at, certifies: of the rule sets made of the first, the first
two, ... signals, each rejects a number of good documents that is binomial, so an
exact (Clopper-Pearson) bound on its false rejection rate holds at any size.  They
are tested in this fixed order, each with the stratum's whole error level, up to
the first that fails (fixed-sequence testing); over strata the level is divided
(Bonferroni).  So with probability 1 - error at least, in every stratum all rules
together reject at most ``risk`` of the good documents.  A stratum with too few
labels to certify anything has no rules.  Copies of a text are one trial.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.text import IS_SEPARATOR, Texts, as_texts, checkpointed, grams, mix, widened

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?{}[]=~^_@\\")] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Signals and their cutoffs, loosest first: stated in advance, not taken from data.
CUTOFFS = {
    "symbols": [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.95, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.11, 0.08],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "marks": [1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.13, 0.1, 0.07, 0.05, 0.035, 0.025],
    "long_words": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.5, 9.0],
    "few_short": [0.999, 0.98, 0.96, 0.94, 0.92, 0.9, 0.87, 0.84, 0.81, 0.78, 0.75, 0.72],
}
SIGNALS = list(CUTOFFS)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _seen_before(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: equal to an earlier item of the same owner; equal to any other."""
    key = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, any_other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:][same]] = True
    any_other[order[1:][same]] = True
    any_other[order[:-1][same]] = True
    return earlier, any_other


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts and the signals of each text."""
    data, off, n = texts.data, texts.offsets, texts.n
    starts, ends, owner = texts.word_bounds()
    points = (data & 0xC0) != 0x80
    inside = ~IS_SEPARATOR[data]
    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": _per_text(points & inside, off),
        "n_symbols": _per_text(_IS_SYMBOL[data], off),
    }
    breaks = np.flatnonzero(data == 10)
    line_owner = np.concatenate([np.arange(n), np.searchsorted(off, breaks, side="right") - 1])
    line_starts = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((line_starts, line_owner))
    line_owner, line_starts = line_owner[order], line_starts[order]
    line_ends = np.append(line_starts[1:] - 1, off[-1])
    last = np.append(line_owner[1:] != line_owner[:-1], True)
    line_ends[last] = off[1:][line_owner[last]]
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[line_ends] > filled[line_starts]
    a, b, own = line_starts[worded], line_ends[worded], line_owner[worded]
    earlier, _ = _seen_before(own, texts.hash_spans(a, b))
    out["n_dup_lines"] = np.bincount(own[earlier], minlength=n)
    lines = np.bincount(own, minlength=n)

    h, first = grams(texts.hash_spans(starts, ends), owner, 5)
    _, repeated = _seen_before(owner[first], h)
    delta = np.zeros(len(starts) + 6, np.int64)
    np.add.at(delta, first[repeated], 1)
    np.add.at(delta, first[repeated] + 5, -1)
    covered = np.cumsum(delta)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)

    letters, words = np.maximum(out["word_chars"], 1), np.maximum(out["n_words"], 1)
    short = np.bincount(owner[ends - starts <= 3], minlength=n)
    out |= {
        "symbols": out["n_symbols"] / letters,
        "dup_lines": out["n_dup_lines"] / np.maximum(lines, 1),
        "repeats": out["n_repeat_words"] / words,
        "capitals": _per_text(_IS_UPPER[data], off) / letters,
        "marks": _per_text(_IS_MARK[data], off) / words,
        "long_words": out["word_chars"] / words,
        "few_short": 1 - short / words,
    }
    return {k: v.astype(np.int64) if k in BASE else v.astype(np.float64) for k, v in out.items()}


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _measured(column) -> dict[str, np.ndarray]:
    parts = [measure(t) for _, _, t in as_texts(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in [*BASE, *SIGNALS]}


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, mark (a hash of the text), stratum, base counts and base_failed, and for each signal the number of cutoffs that it exceeds, of every row.

    Null, empty and wordless texts: all counts 0, base_failed.  A null stratum, or no
    such column: the empty one.  Ties and repeated rows are measured one by one;
    other columns are not looked at.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _measured(batch.column("text"))
            arrays = [batch.column("doc_id"), batch.column("mark"), batch.column("stratum"), *(pa.array(m[k].astype(np.int64)) for k in BASE), pa.array(base_failed(m).astype(bool))]
            arrays += [pa.array(exceeded(k, m[k]).astype(np.int32)) for k in SIGNALS]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "stratum", *BASE, "base_failed", *SIGNALS])

    schema = "doc_id bigint, mark bigint, stratum string, " + "".join(f"{k} bigint, " for k in BASE) + "base_failed boolean, " + ", ".join(f"{k} int" for k in SIGNALS)
    own = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), own.alias("stratum"), text.alias("text")).mapInArrow(made, schema)


def exceeded(signal: str, values: np.ndarray) -> np.ndarray:
    """Of the cutoffs (falling), how many lie below each value."""
    return sum((values > c).astype(np.int64) for c in CUTOFFS[signal])


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n has probability ``error``."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0):
            break
        lo, hi = (mid, hi) if below(mid) > error else (lo, mid)
    return hi


def order_rules(table: dict[str, dict[bool, list[int]]], cost: float = 5.0) -> list[tuple[str, int]]:
    """(signal, index of its cutoff), the most useful first, from the choosing part.

    table: for each signal, good and bad documents by the number of cutoffs exceeded.
    A good document that is rejected costs as much as ``cost`` bad ones gain.
    """
    out = []
    for k, by in table.items():
        gains = [(sum(by[False][i + 1 :]) - cost * sum(by[True][i + 1 :]), -i) for i in range(len(CUTOFFS[k]))]
        best, i = max(gains)
        if best > 0:
            out.append((best, k, -i))
    return [(k, i) for _, k, i in sorted(out, key=lambda x: (-x[0], SIGNALS.index(x[1])))]


def certified(wrong: list[int], n: int, risk: float, error: float) -> int:
    """How many of the nested rule sets hold; wrong: the good documents that each rejects, of n that certify."""
    k = 0
    while k < len(wrong) and upper_bound(wrong[k], n, error) <= risk:
        k += 1
    return k


def shares(good: dict[str, int], risk: float, error: float) -> dict[str, float]:
    """The error level that each stratum begins with; good: how many good documents certify in it.

    Equal parts for as many strata as possible that could hold a rule which rejects
    none of their good documents, the largest first.  The others would waste theirs
    and begin with none.  The numbers say nothing of what rules reject, so levels
    may depend on them.
    """
    order = sorted(good, key=lambda s: (-good[s], s))
    most = max((k for k, s in enumerate(order, 1) if (1 - risk) ** good[s] <= error / k), default=0)
    return {s: error / most if k < most else 0.0 for k, s in enumerate(order)}


def settle(wrong: dict[str, list[int]], good: dict[str, int], risk: float, error: float) -> dict[str, tuple[int, float]]:
    """{stratum: (number of its rules that hold, its level)}; wrong as in certified.

    A stratum of which all rules hold hands its level on to the next smaller one, as
    in the fallback procedure.
    """
    level, out, spare = shares(good, risk, error), {}, 0.0
    for s in sorted(wrong, key=lambda s: (-good[s], s)):
        own = level[s] + spare
        k = certified(wrong[s], good[s], risk, own)
        out[s] = (k, own)
        spare = own if k == len(wrong[s]) else 0.0
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> dict[str, dict[str, int]]:
    """{stratum: {signal: index of its cutoff}}: the rules of certificates, where there are any."""
    return {s: c["rules"] for s, c in certificates(measured, labels, risk, error).items() if c["rules"]}


def certificates(measured: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> dict[str, dict]:
    """For each stratum that useful cutoffs were chosen for: its rules, and what they rest on.

    rules: {signal: index of its cutoff}; good: the good documents that certify;
    rejected: how many of them the rules reject; level: the error level; bound:
    the upper bound of the share of good documents that the rules reject (of the
    first rule, where none holds); reason: why no further rule holds, if one was left.

    All labelled documents that pass the base rules take part.  Labels without doc_id or quality don't count; of several for one document, or
    for documents of one text, the largest does.  One text in three chooses, the
    others certify.  What reaches the driver are counts by stratum, signal and
    cutoff, whatever the number of labels.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    joined = measured.where(~F.col("base_failed")).join(own, "doc_id")
    trials = joined.groupBy("stratum", "mark").agg(F.max("good").alias("good"), *(F.first(k).alias(k) for k in SIGNALS))
    trials = checkpointed(trials.withColumn("chooses", F.pmod(F.xxhash64(F.lit(3), "mark"), F.lit(3)) == 0))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("bin")) for k in SIGNALS))).alias("x")
    tables: dict[str, dict[str, dict[bool, list[int]]]] = {}
    for r in trials.where("chooses").select("stratum", "good", pairs).groupBy("stratum", "good", "x.signal", "x.bin").agg(F.count(F.lit(1)).alias("n")).collect():
        by = tables.setdefault(r["stratum"], {k: {g: [0] * (len(CUTOFFS[k]) + 1) for g in (True, False)} for k in SIGNALS})
        by[r["signal"]][r["good"]][r["bin"]] += r["n"]
    orders = {s: found for s, t in sorted(tables.items()) if (found := order_rules(t))}
    if not orders:
        return {}
    first = F.lit(len(SIGNALS))  # the first rule of its stratum that rejects a document
    for s, found in orders.items():
        own = F.lit(len(SIGNALS))
        for j in reversed(range(len(found))):
            own = F.when(F.col(found[j][0]) > found[j][1], F.lit(j)).otherwise(own)
        first = F.when(F.col("stratum") == s, own).otherwise(first)
    hits = {s: [0] * (len(SIGNALS) + 1) for s in orders}
    for r in trials.where("good and not chooses").groupBy("stratum", first.alias("first")).agg(F.count(F.lit(1)).alias("n")).collect():
        if r["stratum"] in hits:
            hits[r["stratum"]][r["first"]] += r["n"]
    good = {s: sum(h) for s, h in hits.items()}
    wrong = {s: np.cumsum(hits[s])[: len(found)].tolist() for s, found in orders.items()}
    out = {}
    for s, (k, level) in sorted(settle(wrong, good, risk, error).items()):
        reason = None
        if k < len(wrong[s]):
            none = "its good documents are too few even for a rule that rejects none of them"
            reason = none if (1 - risk) ** good[s] > (level or error) else "the next rule rejects too many good documents"
            if not level and reason != none:
                reason = "larger strata have taken the error level"
        at = max(k, 1) - 1
        bound = upper_bound(wrong[s][at], good[s], level or error)
        out[s] = {"rules": dict(orders[s][:k]), "good": good[s], "rejected": wrong[s][at] if k else 0, "level": level, "bound": bound, "reason": reason}
    return out


def judge(measured: DataFrame, rules: dict[str, dict[str, int]]) -> DataFrame:
    """measured with kept: false if the base rules fail or a rule of the stratum rejects."""
    rejected = F.lit(False)
    for s, by in rules.items():
        for k, i in by.items():
            rejected = rejected | ((F.col("stratum") == s) & (F.col(k) > i))
    return measured.withColumn("kept", ~F.col("base_failed") & ~rejected)


def keep(docs: DataFrame, rules: dict[str, dict[str, int]], stratum: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that the base rules and the certified rules keep; nulls and repeated rows as in features."""

    def kept(batches):
        for batch in batches:
            m = _measured(batch.column(batch.schema.get_field_index("text")))
            at = batch.schema.get_field_index(stratum)
            strata = [x if x is not None else "" for x in batch.column(at).to_pylist()] if at >= 0 else [""] * batch.num_rows
            over = {k: exceeded(k, m[k]) for k in SIGNALS}
            good = ~base_failed(m).astype(bool)
            for j, s in enumerate(strata):
                good[j] = good[j] and not any(over[k][j] > i for k, i in rules.get(s, {}).items())
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    measured = checkpointed(features(docs))  # a few numbers a document
    return judge(measured, calibrate(measured, labels)).select("doc_id", *BASE, "base_failed", "kept")
