"""Repair of conversations against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import repair
from graphloom.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """rows: (initial, text is cut off, must go). The least (cost, initials) over all states, row by row."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for st, (c, audit) in list(best.items()):
                new = (c + 2, audit + "I")
                if new < best.get(turn[st], (1 << 60, "")):
                    best[turn[st]] = new
        return best

    for initial, cut, gone in rows:
        best = inserted(best)
        new = {}

        def offer(st, value, new=new):
            new[st] = min(new.get(st, (1 << 60, "")), value)

        for st, (c, audit) in best.items():
            offer(st, (c + 3, audit + "D"))
            if not gone:
                if initial in follow[st]:
                    offer(follow[st][initial], (c + cut, audit + "K"))
                offer(turn[st], (c + cut + 2, audit + "R"))
        best = new
    best = inserted(best)
    return min(v for st, v in best.items() if st in ("", "a"))


def plain_repair(turns):
    """turns: conv_id, turn, role, text; the digest of each conversation."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in (t for t in turns if t[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort()
        told = [r[1] for r in rows if r[0]]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, _, text in rows:
            solid = text.strip(SPACES)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit = plain_edits(marked)
        lines, state, at = [], "", 0
        for x in audit:
            if x in "IR":
                state = "a" if state == "u" else "u"
            elif x == "K":
                state = marked[at][0]
            if x == "I":
                lines.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            if x != "D":
                lines.append((rows[at][2] if x == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + rows[at][4])
            at += 1
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return out


def answers(df):
    rows = df.collect()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


def random_syms(rng, n):
    return bytes(rng.choice([0, 1, 1, 1, 2, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))


def as_rows(syms):
    return [("suao"[x & 3], x >> 2 == 1, x >> 2 > 1) for x in syms]


def test_search_against_plain_version():
    rng = random.Random(6)
    for k in range(3000):
        syms = random_syms(rng, rng.randrange(1, 14 if k < 2900 else 300))
        cost, audit, end = repair.search(syms, 0, repair.ENDING)
        assert (cost, audit + "I" * repair.ENDS[end]) == plain_edits(as_rows(syms)), syms


def test_bounds_are_never_too_high():
    rng = random.Random(8)
    for _ in range(500):
        syms = random_syms(rng, rng.randrange(1, 12))
        assert repair.least_costs(syms)[0] <= repair.search(syms, 0, repair.ENDING)[0]


def test_segments_make_the_same_path():
    rng = random.Random(7)
    for _ in range(400):
        syms = random_syms(rng, rng.randrange(2, 60))
        size = rng.randrange(1, 9)
        parts = [syms[i : i + size] for i in range(0, len(syms), size)]
        aheads, ahead = [], repair.ENDING
        for p in reversed(parts):
            aheads.append(ahead)
            ahead = [min(c + a for c, a in zip(row, ahead, strict=True)) for row in repair.crossings(p)]
        state, audit = 0, ""
        for p, a in zip(parts, aheads[::-1], strict=True):
            _, more, state = repair.search(p, state, a)
            audit += more
        assert (ahead[0], audit + "I" * repair.ENDS[state]) == plain_edits(as_rows(syms))


def test_long_conversations_take_little_time():
    rng = random.Random(9)
    roles = [1 + i % 2 + 4 * rng.choice([0] * 16 + [1, 2, 3]) for i in range(4000) if rng.random() > 0.05]
    cost, audit, end = repair.search(bytes(roles), 0, repair.ENDING)
    assert (cost, audit + "I" * repair.ENDS[end]) == plain_edits(as_rows(roles))


@pytest.mark.parametrize("segment", [3, 1024])
def test_repair_against_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["Well.", "so", "Yes!", "  ", "", None, "no?\n", "ok. then", "é.", "x" * 5000 + "."]
    turns = []
    for conv in [*range(60), 2**60 + 1, 2**60 + 3, None]:
        for turn in range(rng.randrange(1, 12)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", None])
            row = (conv, None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 3]), role, rng.choice(texts) if rng.random() < 0.7 else f"text {turn}.")
            turns += [row] * rng.choice([1, 1, 1, 1, 2])
    # one conversation holds a third of all rows, and another one text many times
    turns += [(77, i, ["user", "assistant"][i % 2], f"{i}" + "." * (i % 5 > 0)) for i in range(200)] + [(78, 5, "user", "again.")] * 40
    df = spark.createDataFrame(turns, TURNS).withColumn("hash", F.lit(1)).withColumn("SAME", F.lit(1)).withColumn("copies", F.lit("x")).repartition(5)
    assert answers(repair.repaired(repair.damaged(df))) == plain_repair(turns)


def test_repair_at_the_edges(spark):
    frame = lambda rows: repair.repaired(repair.damaged(spark.createDataFrame(rows, TURNS)))
    assert frame([]).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "a"), (None, None, None, None), (5, -(2**63), "user", "b."), (5, 2**63 - 1, "user", "c.")]
    got = answers(frame(rows))
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in plain_repair(rows).items()}


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(QUERIES["op13_conversation_repair"](spark, sf)) == plain_repair(turns)
