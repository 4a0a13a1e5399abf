"""Repair of the turns of conversations by iterative-deepening A*.

A conversation's roles should read system, if any, then user and assistant by turns, ending with
assistant. Rows may be kept, given another role or deleted, and rows without text may be
inserted. The cheapest edits are found by depth-first search in the order of their initials (D,
I, K, R) under a cost bound that rises to the least cost that went beyond it. A table keeps for each
state (row, what the roles so far allow) the cost that failed searches have shown to be needed from there; it
prunes, and it makes each search raise some bound, so that states are seldom entered again. The first
accepting path is the cheapest one whose initials come first.

A conversation is cut into segments of at most SEGMENT rows, a byte each. One of several segments is not searched by
one task: the least costs from each state to each are found for each segment, folded from the end, and give each segment
the exact cost of what follows it; then all segments are searched for each state that they may be
entered in, and the answers are strung together. An insertion always belongs to the row
after it, so that the first of the cheapest paths is made of the first ones of the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship

ship(__name__)

SEGMENT = 1024
SOLID = r"[^\x20\x09-\x0D]"
#: A row's byte: the class of its role's initial, and its fault times 4. Rows with a fault above TRUNCATED must be deleted.
CLASSES, OTHER = "sua", 3
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; what keeping each class leads to, and what follows from a new role.
KEPT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
NEW = [2, 2, 3, 2]
#: Cost of the insertions that end a conversation in each state, and how many there are.
ENDING, ENDS = [0, 2 * INSERT, INSERT, 0], [0, 2, 1, 0]
FAR = 1 << 60


def least_costs(syms: bytes) -> list[int]:
    """For each row a lower bound of the cost from there on, whatever the state.

    Deletions that must be, cut-off texts, and edits at unlawful roles: of pairs of neighbours that can't both stay
    as they are, with nothing between, those are counted that have no row in common.
    """
    out = [0] * (len(syms) + 1)
    after, taken = None, False
    for i in range(len(syms) - 1, -1, -1):
        c, fault = syms[i] & 3, syms[i] >> 2
        if fault > TRUNCATED:
            out[i] = out[i + 1] + DELETE
            continue
        out[i] = out[i + 1] + (CUT_OFF if fault else 0)
        wrong = c == OTHER or after is not None and not taken and (c, after) not in ((0, 1), (1, 2), (2, 1))
        out[i] += REROLE if wrong else 0
        after, taken = c, wrong
    return out


def search(syms: bytes, entry: int, ahead: list[int]) -> tuple[int, str, int]:
    """Cost, initials and last state of the cheapest path through the rows, what is ahead of each state counted as its end."""
    n = len(syms)
    base = least_costs(syms)
    least = min(ahead)
    low = [[x + least for x in base] for _ in range(4)]
    for state in range(4):
        low[state][n] = ahead[state]
    while True:
        bound = low[entry][0]
        # a frame: row, state, cost so far, next edit, least cost seen beyond the bound, initial that led here
        path = [[0, entry, 0, 0, FAR, ""]]
        while path:
            frame = path[-1]
            i, state, cost, move, _, _ = frame
            if i == n:
                return cost + ahead[state], "".join(f[5] for f in path), state
            if move == 4:
                low[state][i] = max(low[state][i], frame[4])
                path.pop()
                if path:
                    path[-1][4] = min(path[-1][4], cost - path[-1][2] + low[state][i])
                continue
            frame[3] += 1
            c, fault = syms[i] & 3, syms[i] >> 2
            if move == 0:
                step, j, to, name = DELETE, i + 1, state, "D"
            elif move == 1:
                step, j, to, name = INSERT, i, NEW[state], "I"
            elif fault > TRUNCATED:
                continue
            elif move == 2:
                if c not in KEPT[state]:
                    continue
                step, j, to, name = KEEP + (CUT_OFF if fault else 0), i + 1, KEPT[state][c], "K"
            else:
                step, j, to, name = REROLE + (CUT_OFF if fault else 0), i + 1, NEW[state], "R"
            if cost + step + low[to][j] > bound:
                frame[4] = min(frame[4], step + low[to][j])
                continue
            path.append([j, to, cost + step, 0, FAR, name])


def crossings(syms: bytes) -> list[list[int]]:
    """Least cost from each state before the rows to each state after them."""
    out = []
    for entry in range(4):
        now = [FAR] * 4
        now[entry] = 0
        for x in syms:
            c, fault = x & 3, x >> 2
            for _ in range(2):
                for state in range(4):
                    now[NEW[state]] = min(now[NEW[state]], now[state] + INSERT)
            new = [v + DELETE for v in now]
            if fault <= TRUNCATED:
                more = CUT_OFF if fault else 0
                for state in range(4):
                    new[NEW[state]] = min(new[NEW[state]], now[state] + REROLE + more)
                    if c in KEPT[state]:
                        new[KEPT[state][c]] = min(new[KEPT[state][c]], now[state] + more)
            now = [min(v, FAR) for v in new]
        out.append(now)
    return out


def tally(syms: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and cut-off rows, and neighbours whose roles can't follow one another."""
    s = np.frombuffer(syms, dtype=np.uint8)
    faults = np.bincount(s >> 2, minlength=4)
    pair = (s[:-1] & 3) * 4 + (s[1:] & 3)
    return int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), int((~np.isin(pair, [1, 6, 9])).sum())


def without_forced(syms: bytes, audit: str) -> str:
    """The initials of edits at rows that need not be deleted, insertions included."""
    out, i = [], 0
    for x in audit:
        if x == "I" or i < len(syms) and syms[i] >> 2 <= TRUNCATED:
            out.append(x)
        i += x != "I"
    return "".join(out)


# tasks


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as segments: conv_id, part, place, syms."""
    part = TaskContext.get().partitionId()
    now, place, held = None, 0, bytearray()
    schema = None

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal place
        while len(held) >= SEGMENT or last and held:
            yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "part": part, "place": place, "syms": bytes(held[:SEGMENT])}], schema=schema)
            del held[:SEGMENT]
            place += 1

    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("place", pa.int64()), ("syms", pa.binary())])
        done = []
        for conv, sym, more, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "sym", "more", "again")), strict=True):
            if now != (conv,):
                done += cut(True)
                now, place = (conv,), 0
            held.append(sym)
            while more:
                some = min(more, SEGMENT)
                held.extend(bytes([again]) * some)
                more -= some
                done += cut(False)
            done += cut(False)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if held:
        yield from cut(True)


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [[x for row in crossings(s) for x in row] for s in batch.column("syms").to_pylist()]
        yield batch.drop_columns(["syms"]).append_column("costs", pa.array(costs, pa.list_(pa.int64())))


def _ahead(table: pa.Table) -> pa.Table:
    """For each segment of a conversation the cost of what follows, for each state that it may be left in."""
    table = table.sort_by([("part", "ascending"), ("place", "ascending")])
    ahead, out = ENDING, []
    for costs in reversed(table.column("costs").to_pylist()):
        out.append(ahead)
        ahead = [min(c + a for c, a in zip(costs[4 * e : 4 * e + 4], ahead, strict=True)) for e in range(4)]
    n = len(out)
    table = table.drop_columns(["costs"])
    return table.append_column("ahead", pa.array(out[::-1], pa.list_(pa.int64()))).append_column("first", pa.array([i == 0 for i in range(n)])).append_column("last", pa.array([i == n - 1 for i in range(n)]))


FOUND = [("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("plan", pa.string())]
TALLY = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
ENDS_OF = [("head", pa.int32()), ("tail", pa.int32())]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment, and each state that it may be entered in, what is found there. Without ahead a segment is the whole conversation."""
    for batch in batches:
        out, row = [], []
        for k, (syms, ahead, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("syms", "ahead", "first", "last")), strict=True)):
            alone = ahead is None
            for entry in (0,) if alone or first else range(4):
                total, audit, end = search(syms, entry, ENDING if alone else ahead)
                cost = total - (0 if alone or last else ahead[end])
                ending = "I" * ENDS[end] if alone or last else ""
                out.append((entry, end, cost, audit + ending, without_forced(syms, audit) + ending, *tally(syms), syms[0] & 3, syms[-1] & 3))
                row.append(k)
        names = [*FOUND, *TALLY, *ENDS_OF]
        columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True) if out else [[]] * len(names), names, strict=True)]
        kept = batch.select(["conv_id", "part", "place", "ahead"]).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *[c for c, _ in names]])


def _strung(table: pa.Table) -> pa.Table:
    """One answer from those of a conversation's segments."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["place"]))
    state, tail, got = 0, None, {"cost": 0, "audit": [], "plan": [], **{c: 0 for c, _ in TALLY}}
    for _, entries in groupby(rows, key=lambda r: (r["part"], r["place"])):
        r = next(r for r in entries if r["entry"] == state)
        got["illegal"] += tail is not None and (tail, r["head"]) not in ((0, 1), (1, 2), (2, 1))
        for c in ("cost", *[c for c, _ in TALLY]):
            got[c] += r[c]
        got["audit"].append(r["audit"])
        got["plan"].append(r["plan"])
        state, tail = r["exit"], r["tail"]
    got |= {"conv_id": rows[0]["conv_id"], "audit": "".join(got["audit"]), "plan": "".join(got["plan"])}
    names = [("conv_id", table.schema.field("conv_id").type), *FOUND[2:], *TALLY]
    return pa.Table.from_pylist([got], schema=pa.schema(names))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation; its plan comes first, then its rows. No more than a batch of texts is held."""
    now, plan, at, state, hashed, empty, schema = None, "", 0, 0, None, True, None

    def put(role: str, text: str) -> None:
        nonlocal empty
        hashed.update((("" if empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        empty = False

    def insertions() -> None:
        nonlocal at, state
        while plan[at : at + 1] == "I":
            state, at = NEW[state], at + 1
            put("user" if state == 2 else "assistant", "")

    def close(out: list) -> None:
        if now is not None:
            insertions()
            out.append({"conv_id": now[0], "repaired_sha256": hashed.hexdigest()})

    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
        out: list[dict] = []
        for conv, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text")), strict=True):
            if own is not None:
                close(out)
                now, plan, at, state, hashed, empty = (conv,), own, 0, 0, hashlib.sha256(), True
                continue
            insertions()
            edit, at = plan[at], at + 1
            if edit == "K":
                state = KEPT[state][CLASSES.index(role[0])]
                put(role, text)
            elif edit == "R":
                state = NEW[state]
                put("user" if state == 2 else "assistant", text)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if schema is not None:
        out = []
        close(out)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# operators


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of turns, damaged by the crc32 of `conv_id:turn`, modulo 20.

    0: no copy is left, 1: the text is emptied, 2: it loses its `[.!?]`, 3: there are two copies, 4: the role is user. A null
    counts as one space, but a null turn stays null.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(kind == 4, "user").otherwise(told("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of turns.

    turns: conv_id, turn, role, text, copies (how often the row is there, which may be 0). Rows are taken by turn, null turns
    first; of those with the same turn by role and then by the text's md5, so that equal rows, which are counted before anything is
    shuffled by conversation, stand together. gaps: turns that are missing between the first and the last, null ones
    ignored. A row's fault is the first of: blank, no character but white space (an empty text too); duplicate, role and text
    seen earlier in the conversation; truncated, the last character that isn't white space is none of `.!?`. illegal: neighbours whose
    roles' initials aren't su, ua or au. audit: the initials of the cheapest edits (Delete, Insert, Keep, Rerole) after which the
    roles' initials read `(s?(ua)+)?`; of equally cheap ones the first. A null conv_id is a conversation like any other; null roles and
    texts count as one space. A conversation without rows has noughts, an empty audit and the hash of an empty text. An empty
    table gives no rows. Texts are used whole, however long; other columns, whatever their names, are ignored.

    What grows with one conversation in one task: a byte for a row where its audit is strung together, which is one string, and the
    time to hash its repaired text, which is one text.
    """
    blank_for = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = turns.select("conv_id", "turn", blank_for("role"), blank_for("text"), "copies")
    there = F.when(F.col("copies") > 0, F.col("turn"))
    every = turns.groupBy("conv_id").agg(F.coalesce(F.try_subtract(F.try_add(F.try_subtract(F.max(there), F.min(there)), F.lit(1)), F.countDistinct(there)), F.lit(0)).cast("long").alias("gaps"))

    rows = turns.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    blank = ~F.col("text").rlike(SOLID)
    cut_off = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    letter = F.substring("role", 1, 1)
    kind = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(OTHER)
    # the role's length keeps role and text apart
    rows = rows.withColumn("hash", F.md5("text")).withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = checkpoint(rows.withColumn("kind", kind).withColumn("blank", blank).withColumn("cut_off", cut_off))

    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    small = rows.select("conv_id", "turn", "role", "hash", "same", "copies", "kind", "blank", "cut_off", at.alias("at"))
    earliest = small.groupBy("conv_id", "same").agg(F.min("at").alias("earliest")).toDF("its", "its_same", "earliest")
    small = small.join(earliest, (F.col("same") == F.col("its_same")) & F.col("conv_id").eqNullSafe(F.col("its")))
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("earliest"), DUPLICATE).when(F.col("cut_off"), TRUNCATED).otherwise(FINE)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    small = small.select("conv_id", "turn", "role", "hash", (F.col("kind") + fault * 4).alias("sym"), (F.col("copies") - 1).alias("more"), (F.col("kind") + again * 4).alias("again"))
    small = checkpoint(small)
    conv = dict(turns.dtypes)["conv_id"]
    cut = checkpoint(small.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, f"conv_id {conv}, part int, place long, syms binary"))

    several = cut.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("long_id"))
    crossed = cut.join(several, cut["conv_id"].eqNullSafe(F.col("long_id")), "left_semi").mapInArrow(_crossed, f"conv_id {conv}, part int, place long, costs array<long>")
    ahead = crossed.groupBy("conv_id").applyInArrow(_ahead, f"conv_id {conv}, part int, place long, ahead array<long>, first boolean, last boolean").withColumnRenamed("conv_id", "long_id")
    mine = cut["conv_id"].eqNullSafe(ahead["long_id"]) & (cut["part"] == ahead["part"]) & (cut["place"] == ahead["place"])
    known = cut.join(ahead, mine, "left").select(cut["conv_id"], cut["part"], cut["place"], "syms", "ahead", "first", "last")
    counts = "cost long, audit string, plan string, blank long, duplicate long, truncated long, illegal long"
    found = checkpoint(known.mapInArrow(_searched, f"conv_id {conv}, part int, place long, ahead array<long>, entry int, exit int, {counts}, head int, tail int"))
    names = ["conv_id", *[c.split()[0] for c in counts.split(", ")]]
    strung = found.filter("ahead is not null").drop("ahead").groupBy("conv_id").applyInArrow(_strung, f"conv_id {conv}, {counts}")
    answers = checkpoint(found.filter("ahead is null").select(*names).unionByName(strung.select(*names)))

    # texts are shuffled once, those that must be deleted left out
    staying = small.filter(F.shiftright("sym", 2) <= TRUNCATED).select(F.col("conv_id").alias("its"), F.col("turn").alias("its_turn"), F.col("role").alias("its_role"), F.col("hash").alias("its_hash"))
    fine = rows["conv_id"].eqNullSafe(F.col("its")) & rows["turn"].eqNullSafe(F.col("its_turn")) & (rows["role"] == F.col("its_role")) & (rows["hash"] == F.col("its_hash"))
    texts = rows.join(staying, fine, "left_semi").select("conv_id", F.lit(None).cast("string").alias("plan"), "turn", "role", "hash", "text")
    plans = answers.select("conv_id", "plan", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c in ("turn", "role", "text")], F.lit(None).cast("string").alias("hash"))
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("plan").isNull(), *order[1:])
    hashes = both.mapInArrow(_digests, f"conv_id {conv}, repaired_sha256 string").withColumnRenamed("conv_id", "hash_id")

    answers = answers.drop("plan").withColumnRenamed("conv_id", "found_id")
    out = every.join(answers, every["conv_id"].eqNullSafe(F.col("found_id")), "left").join(hashes, every["conv_id"].eqNullSafe(F.col("hash_id")), "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id",
        "gaps",
        *[nought(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
