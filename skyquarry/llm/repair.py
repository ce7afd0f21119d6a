"""Repair of conversations: the cheapest edits that leave an optional system turn and user-assistant pairs.

A retained-subsequence programme: each turn may be kept (0), or reroled to user or
assistant (3), or deleted (4); a deletion is forced for blank and repeated turns,
and a truncated turn that stays costs 3.  The turns that stay form a subsequence;
between two of them lie deletions, priced by prefix sums, and inserted turns (3
each), whose number follows from the two roles.  For each role a running minimum
holds the best end so far, less the prefix sum, so a turn looks at four minima and
not at all its predecessors.  Equal costs are settled by the audit, the edits'
initials: the ASCII-least wins.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.graph import spread_join

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns inserted between two that stay, by the initials of their roles ('' before the first); what isn't here can't be.
INSERTS = {
    ("", "s"): "", ("", "u"): "", ("", "a"): "u",
    ("s", "u"): "", ("s", "a"): "u",
    ("u", "a"): "", ("u", "u"): "a",
    ("a", "u"): "", ("a", "a"): "u",
}
#: Turns inserted after the last one that stays.
CLOSING = {"": "", "s": "ua", "u": "a", "a": ""}
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: What any end saves on another in what is still to come: a system turn that it alone can keep (4), and one insert.
HOPELESS = DELETE + INSERT
#: Turns after which ends without hope go, and what all others have in common is settled.
SETTLE = 256


class Repair:
    """One conversation's turns in order; what is settled is hashed and let go, so memory is that of the audit and of the turns still open."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, str]] = {"": (0, "")}  # by the last role that stays: cost less the deletions so far, edits since the settled ones
        self.deleted = 0
        self.open: list[tuple[str, str]] = []  # turns whose edits aren't settled
        self.audit: list[str] = []
        self.last = ""  # the last role in the settled part
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """gone: blank or repeated, so it must be deleted."""
        ends: dict[str, tuple[int, str]] = {}
        if not gone:
            first = role[:1]
            choices = [(first, "K", 0)] if first in ROLES else []
            choices += [(r, "R", REROLE) for r in "ua" if r != first]
            for r, edit, cost in choices:
                cost += self.deleted + TRUNCATED * truncated
                found = [(c + cost + INSERT * len(i), a + "I" * len(i) + edit) for q, (c, a) in self.best.items() if (i := INSERTS.get((q, r))) is not None]
                if found:
                    ends[r] = min(found)
        self.best = {q: (c, a + "D") for q, (c, a) in self.best.items()}
        self.deleted += DELETE
        for r, (cost, audit) in ends.items():
            own = (cost - self.deleted, audit)
            self.best[r] = min(self.best.get(r, own), own)
        self.open.append((role, text))
        if len(self.open) % SETTLE == 0:
            most = min(c for c, _ in self.best.values()) + HOPELESS
            self.best = {q: (c, a) for q, (c, a) in self.best.items() if c <= most}
            self._settle(os.path.commonprefix([a for _, a in self.best.values()]).rstrip("I"))

    def _settle(self, edits: str) -> None:
        """Applies the edits to the open turns, and takes them off all ends."""
        turn = 0
        for edit in edits:
            role, text = self.open[turn] if edit != "I" else ("", "")
            if edit in "IR":
                role = ROLES["a" if self.last == "u" else "u"]
            turn += edit != "I"
            if edit != "D":
                self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
                self.lines, self.last = self.lines + 1, role[:1]
        del self.open[:turn]
        self.audit.append(edits)
        self.best = {q: (c, a[len(edits) :]) for q, (c, a) in self.best.items()}

    def done(self) -> tuple[int, str, str]:
        """Cost, audit, and the digest of the repaired turns."""
        cost, audit = min((c + self.deleted + INSERT * len(CLOSING[q]), a + "I" * len(CLOSING[q])) for q, (c, a) in self.best.items())
        self._settle(audit)
        return cost, "".join(self.audit), self.digest.hexdigest()


FIELDS = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _reports(turns: Iterable[dict]) -> Iterator[tuple]:
    """One row a conversation, of turns that come conversation by conversation and in order."""
    now, some = None, False

    def report() -> tuple:
        gaps = 0 if low is None else high - low + 1 - distinct
        return (now, gaps, *counts, *repair.done())

    for t in turns:
        if not some or t["conv_id"] != now:
            if some:
                yield report()
            now, some, repair, counts = t["conv_id"], True, Repair(), [0, 0, 0, 0]
            low = high = before = None
            distinct = 0
        for copy in range(t["copies"]):
            if copy == 0 and t["turn"] is not None and t["turn"] != high:
                low, high, distinct = t["turn"] if low is None else low, t["turn"], distinct + 1
            duplicate = not t["blank"] and (copy > 0 or t["seen"])
            truncated = not t["blank"] and not duplicate and t["cut"]
            for k, fault in enumerate((t["blank"], duplicate, truncated, before is not None and before + t["role"][:1] not in LEGAL)):
                counts[k] += fault
            before = t["role"][:1]
            repair.add(t["role"], t["text"], t["blank"] or duplicate, truncated)
    if some:
        yield report()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in _reports(t for b in batches for t in b.to_pylist()):
        rows.append(row)
        if len(rows) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of conversations after the fixed damage, nulls in role and text (and in the damage's key) as one space.

    Equal rows are one row with a number of copies; a dropped row has none.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns(conv_id, turn, role, text, copies): its faults, the cheapest repair, the audit and the repaired text's digest.

    Turns are ordered by turn (nulls first), then role and text; copies of a row
    follow it.  A turn's first fault counts: blank, duplicate (role and text seen
    earlier), truncated.  A role is known by its initial: one that is not s, u or a
    can only be reroled or deleted.  A null conv_id is a conversation of its own; one
    of which no copies are left has zeros, an empty audit and the digest of nothing.
    No rows give none; other columns are not looked at.

    Equal rows meet as a count, and where a role and text were first seen is found
    by a grouped minimum joined back with salts, so a turn that fills a third of all
    rows meets in no task.  A conversation is read in one task, as its audit is one
    string and its digest sequential; it is read as a stream, see Repair.
    """
    rows = turns.select("conv_id", "turn", "role", "text", "copies")
    content = (F.col("conv_id").isNull(), "conv_id", "role", "text")
    rows = rows.withColumn("mark", F.xxhash64(*content)).withColumn("mark2", F.xxhash64(F.lit(7), *content))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = rows.where("copies > 0").groupBy("mark", "mark2").agg(F.min(at).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = spread_join(rows, first, ["mark", "mark2"], ["turn"], "left")
    seen = F.col("least").isNotNull() & ~at.eqNullSafe(F.col("least"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"), blank.alias("blank"), (~whole).alias("cut"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_repaired, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


ORACLE = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
k AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, t),
d AS (SELECT c, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
g AS MATERIALIZED (SELECT c, i, role, text, r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM f),
w AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': ''} AS b0, {'c': CAST(1000000000 AS BIGINT), 'a': ''} AS bs, {'c': CAST(1000000000 AS BIGINT), 'a': ''} AS bu, {'c': CAST(1000000000 AS BIGINT), 'a': ''} AS ba FROM o
  UNION ALL
  SELECT w.c, g.i, {'c': b0.c + 4, 'a': b0.a || 'D'},
    list_min([{'c': bs.c + 4, 'a': bs.a || 'D'}, {'c': CASE WHEN gone OR r <> 's' THEN 2000000000 ELSE b0.c + cut END, 'a': b0.a || 'K'}]),
    list_min([{'c': bu.c + 4, 'a': bu.a || 'D'}]
      || list_transform([{'c': b0.c, 'a': b0.a}, {'c': bs.c, 'a': bs.a}, {'c': bu.c + 3, 'a': bu.a || 'I'}, {'c': ba.c, 'a': ba.a}],
           lambda z: {'c': CASE WHEN gone THEN 2000000000 ELSE z.c + cut + CASE WHEN r = 'u' THEN 0 ELSE 3 END END, 'a': z.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END})),
    list_min([{'c': ba.c + 4, 'a': ba.a || 'D'}]
      || list_transform([{'c': b0.c + 3, 'a': b0.a || 'I'}, {'c': bs.c + 3, 'a': bs.a || 'I'}, {'c': bu.c, 'a': bu.a}, {'c': ba.c + 3, 'a': ba.a || 'I'}],
           lambda z: {'c': CASE WHEN gone THEN 2000000000 ELSE z.c + cut + CASE WHEN r = 'a' THEN 0 ELSE 3 END END, 'a': z.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}))
  FROM w JOIN g ON g.c = w.c AND g.i = w.i + 1),
e AS MATERIALIZED (
  SELECT c, list_min([b0, {'c': bs.c + 6, 'a': bs.a || 'II'}, {'c': bu.c + 3, 'a': bu.a || 'I'}, ba]) AS b
  FROM w JOIN (SELECT o.c AS oc, coalesce(max(g.i), 0) AS most FROM o LEFT JOIN g ON g.c = o.c GROUP BY 1) ON oc = c AND i = most),
u AS (SELECT c, p, b.a[p] AS edit, len(replace(left(b.a, p), 'I', '')) AS i, len(replace(left(b.a, p), 'D', '')) AS m FROM (SELECT *, unnest(range(1, len(b.a) + 1)) AS p FROM e)),
h AS (SELECT u.c, p, m, edit, g.role, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text, max(CASE WHEN m = 1 AND edit = 'K' AND g.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.c) AS sys
      FROM u LEFT JOIN g ON g.c = u.c AND g.i = u.i WHERE edit <> 'D'),
x AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM h GROUP BY c),
s AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY c),
l AS (SELECT c, count(*) AS illegal FROM (SELECT c, lag(r) OVER (PARTITION BY c ORDER BY i) || r AS pair, i FROM f) WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au') GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM o) q JOIN e USING (c) LEFT JOIN x USING (c) LEFT JOIN s USING (c) LEFT JOIN l USING (c)
"""
