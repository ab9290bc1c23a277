"""Repairs against a forward search over (cost, edits), whole and in pieces."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from trolley.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, gone string, h1 int"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        own = out[conv]
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode(), seed=seed).intdigest()
    return seed - (1 << 64) * (seed >> 63)


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), spark_hash(r[1], r[2])))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    role_of = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def insert(best):
        todo = list(best)
        while todo:
            q = todo.pop()
            cost, audit, kept = best[q]
            for x, to in step[q].items():
                new = (cost + 5, audit + "I", (*kept, (role_of.get(x, ""), "")))
                if x != "s" and (to not in best or new[:2] < best[to][:2]):
                    best[to] = new
                    todo.append(to)

    insert(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(to, new, after=after):
            if to not in after or new[:2] < after[to][:2]:
                after[to] = new

        for q, (cost, audit, kept) in best.items():
            offer(q, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for x, to in step[q].items():
                if role[:1] == x:
                    offer(to, (cost + more, audit + "K", (*kept, (role, text))))
                if x != "s":
                    offer(to, (cost + 1 + more, audit + "R", (*kept, (role_of[x], text))))
        best = after
        insert(best)
    cost, audit, kept = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    count = Counter(faults)
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "a", "User", "", None], ["Yes.", "no", "Why?", "", None, " \n", "a. \t", "wait...", "x!y", "é。", "one two"]
    out = []
    for conv in [*range(60), None, 2**53 + 1]:
        for k in range(rng.choice([1, 1, 2, 4, 5, 8, 13, 40])):
            turn = rng.choice([k, k, k, k + 3, None, k // 2])
            role = rng.choice(["user", "assistant"][k % 2 : k % 2 + 1] * 12 + roles)
            out.append((conv, turn, role, rng.choice([f"text {k}."] * 14 + texts), "x", 1))
    out += [(conv, 0, "user", "alone.", "x", 1) for conv in range(100, 180)]
    return out + out[:7] + [(999, 2**62, "user", "ok.", "x", 1), (999, -(2**62), "assistant", "ok.", "x", 1)]


@pytest.mark.parametrize("size", [1, 3, 8192])
def test_repair(spark, rows, size, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", size)
    monkeypatch.setattr(queries, "_table", lambda *_: spark.createDataFrame(rows, SCHEMA).repartition(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2" if size < 9 else "2000")
    try:
        found = queries.op11_conversation_repair(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(got) == len(found)
    hurt = damage(rows)
    want = {conv: plain(own) for conv, own in hurt.items()}
    assert any(not own for own in hurt.values())
    for conv in want:
        assert got[conv] == want[conv], (conv, hurt[conv])
    assert got.keys() == want.keys()


def test_no_rows(spark):
    assert not conversations.repaired(conversations.damaged(spark.createDataFrame([], SCHEMA))).count()


def test_buckets_hold_like_lengths():
    import numpy as np

    n = np.array([0, 1, 9, 3, 4, 5, 100, 8, 2])
    found = conversations.buckets(n)
    assert sorted(np.concatenate(found).tolist()) == list(range(9))
    assert all(n[b].max() <= 2 * max(1, n[b].min()) for b in found)
