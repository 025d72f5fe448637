"""Repair against all edits tried one by one: faults, ties, nulls, repeated rows, segments, long texts, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lakeforge.llm.conversations import GRAMMAR, Row, damage, join, paths, repair

KIND = "conv_id long, turn long, role string, text string, copies int, kind string, hash int, conv string, summary int"
GOOD = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) after damage, in order; conversations without rows too."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    mark = lambda t: hashlib.md5(t.encode()).hexdigest()
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[2]))) for c, rs in out.items()}


def classified(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def dearest(rows, faults):
    """Every sequence of edits with at most two insertions in a row, cheapest first by cost, then string."""
    best = None
    choices = [("D",) if f in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for f in faults]
    runs = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        cost = sum({"D": 4, "K": 0}.get(e, 3) + 3 * (f == "truncated" and e != "D") for e, f in zip(edits, faults, strict=True))
        if best and cost > best[0]:
            continue
        for inserted in itertools.product(runs, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, inserted))
            if best and total > best[0]:
                continue
            out, audit, roles = [], "", ""
            for k, run in enumerate(inserted):
                out += [f"{ {'u': 'user', 'a': 'assistant'}[x] }:" for x in run]
                audit, roles = audit + "I" * len(run), roles + run
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k] != "D":
                        role = rows[k][1] if edits[k] == "K" else {"u": "user", "a": "assistant"}[edits[k][1]]
                        roles += role[:1] or "-"
                        out.append(f"{role}:{rows[k][2]}")
            if GOOD.fullmatch(roles) and (best is None or (total, audit) < best[:2]):
                best = (total, audit, out)
    return best


def brute(rows):
    out = {}
    for conv, rs in damaged(rows).items():
        faults = classified(rs)
        turns = {r[0] for r in rs if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rs))
        cost, audit, lines = dearest(rs, faults) if rs else (0, "", [])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(0, most)):
            text = rng.choice(["Yes.", "No!", "no end", "Why? \t", "", " \n", None, "a.b.c", "é ü。"])
            rows.append((conv, rng.choice([turn, turn + 1, None]) if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), text))
    rng.shuffle(rows)
    return rows


def repaired(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 7, "k", 1, "c", 2) for r in rows], KIND).repartition(parts)
    return {r.conv: tuple(r)[1:] for r in repair(damage(df), **more).collect()}


def test_equals_all_edits(spark):
    rows = made(1, 150, 4)
    want = brute(rows)
    assert repaired(spark, rows) == want and sum(v[5] > 0 for v in want.values()) > 100
    assert repaired(spark, rows, segment=1) == want


def test_long_conversations_by_segments(spark):
    rng = random.Random(4)
    rows = [(c, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "system", rng.choice(["Yes.", "no end", f"{t}!"])) for c in (1, 2) for t in range(700)]
    rows += [(2, 350, "user", "Same.")] * 60
    whole = repaired(spark, rows, segment=10**6)
    assert whole == repaired(spark, rows, parts=7, segment=16) == repaired(spark, rows, segment=1)
    by = damaged(rows)
    assert {c: len(v[6].replace("I", "")) for c, v in whole.items()} == {c: len(r) for c, r in by.items()}


def test_first_rows_alone_and_extremes(spark):
    long = "x" * 400_000 + "."
    rows = [(10**6 + k, None, "user", "Hi.") for k in range(40)] + [(1, 5, "user", long), (1, 6, "assistant", long)]
    assert repaired(spark, rows) == brute(rows)


def test_empty(spark):
    assert repaired(spark, []) == {}


def test_segments_join_to_the_same_weight():
    """Strings of different length: what is cut anywhere gives what is whole, and equals edits tried one by one."""
    rng = random.Random(9)
    symbols = [Row(i, m, t) for i in ("s", "u", "a", "") for m in (False, True) for t in (False, True)]
    for _ in range(300):
        rows = [(rng.choice(symbols), 1) for _ in range(rng.randint(1, 9))]
        whole = join([paths(rows, (0,))])
        cut = rng.randint(0, len(rows))
        states = tuple(range(len(GRAMMAR)))
        parts = [p for p in (rows[:cut], rows[cut:]) if p]
        assert join([paths(p, states) for p in parts]) == whole


@pytest.mark.parametrize("copies", [0, 5])
def test_counted_rows(spark, copies):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", copies)], "conv long, turn long, role string, text string, copies long")
    got = repair(df, segment=2).first()
    assert (got.duplicate, got.audit) == ((4, "KDDDDI") if copies else (0, "")) and got.cost == (19 if copies else 0)


def test_damage_of_the_query(spark):
    rows = [(c, t, "system", "A. b! c?") for c in range(30) for t in range(8)]
    out = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where(F.col("copies") > 0)
    want = sorted((c, *r) for c, rs in damaged(rows).items() for r in rs)
    assert sorted(tuple(r)[:4] for r in out.collect() for _ in range(r.copies)) == want
