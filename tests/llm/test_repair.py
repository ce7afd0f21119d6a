"""op11 against every possible edit, on small conversations with odd rows; settling early against settling late."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skyquarry.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def fits(edits, rows):
    """The repaired turns, or None: roles that aren't kept are whatever the pattern asks for."""
    out, turn = [], 0
    for e in edits:
        role, text = rows[turn] if e != "I" else (None, "")
        turn += e != "I"
        if e != "D":
            out.append((role if e == "K" else None, text))
    body = out[1:] if out and (out[0][0] or "")[:1] == "s" else out
    if len(body) % 2 or (out and not body):
        return None
    named = out[: len(out) - len(body)]
    for k, (role, text) in enumerate(body):
        if role is not None and role[:1] != "ua"[k % 2]:
            return None
        named.append((["user", "assistant"][k % 2] if role is None else role, text))
    return named


def cheapest(rows, must, cut):
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(m and e != "D" for m, e in zip(must, edits, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, edits, strict=False)) + "I" * inserts[-1]
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for c, e in zip(cut, edits, strict=True) if c and e != "D")
            if (best is None or (cost, audit) < best[:2]) and (named := fits(audit, rows)) is not None:
                best = (cost, audit, named)
    return best


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        faults, seen = [], set()
        for _, _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        cost, audit, named = cheapest([r[2:] for r in own], [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in named).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


def some(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None, -3]:
        for _ in range(rng.randrange(1, 5)):
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "no end", "", None, "\t\n ", "Ünïcode? ", "Yes.", "a\x1c.\x1f"])))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    return [r for conv in {r[0] for r in rows} for r in [x for x in rows if x[0] == conv][:5]]


def run(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in repair.repair(repair.damaged(spark.createDataFrame(rows, schema).repartition(3))).select(*COLUMNS).collect()), key=repr)


def test_cheapest_edits_on_odd_rows(spark):
    rows = [r for r in some(5, 40)]
    assert max(sum(r[0] == c for r in damaged(rows)) for c in {r[0] for r in rows}) <= 8
    small = [r for r in rows if sum(x[0] == r[0] for x in damaged(rows)) <= 5]
    assert len(small) > 40
    assert run(spark, small) == expected(small)


def test_extra_columns_and_empty_tables(spark):
    schema = SCHEMA + ", mark string, seen int, copies string, least int, salt int"
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    assert run(spark, [(*r, "x", 1, "y", 2, 3) for r in rows], schema) == run(spark, rows)
    assert run(spark, [], schema) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert run(spark, [(7, gone, "user", "Hi.")]) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("seed", range(6))
def test_settling_changes_nothing(monkeypatch, seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["system", "user", "assistant", "tool"]), str(k), rng.random() < 0.3 * (seed % 2), rng.random() < 0.3) for k in range(700)]

    def result(every):
        monkeypatch.setattr(repair, "SETTLE", every)
        r = repair.Repair()
        most = 0
        for t in turns:
            r.add(*t)
            most = max(most, len(r.open))
        return r.done(), most

    late, early = result(10**9), result(7)
    assert late[0] == early[0]
    assert early[1] < 200 < late[1]
