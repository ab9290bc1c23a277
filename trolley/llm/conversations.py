"""Repair of conversation structure: the cheapest edits after which roles read as an optional system turn and pairs of user and assistant.

Rows are sorted by range of (conversation, turn, role, hash), so that a conversation of any size is spread over tasks, and
each task cuts its rows into segments: a conversation's rows, or a bounded run of them where a conversation goes on beyond
its task's edge or is long. A segment's costs are a time-major tensor: conversations of like length side by side, four role
states each, one vectorised step a turn from the last one back; kept costs let all edits be traced at once.

A conversation inside one task is done in that step. Others are joined by (min, +) algebra: a segment's least costs from each
state to each are a 4 x 4 matrix; a conversation's matrices (small, whatever its texts) give the costs behind each segment and
then, with the segment traced from each state, the state in which it is entered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.workspace import Workspace, partitions

#: What edits cost: keep, rerole, delete, insert; and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, behind system, user, assistant. What a rerole or an insert leads to, and the role that it gives.
NEXT = np.array([2, 2, 3, 2])
GIVEN = np.array([0, 0, 1, 0])  # user, user, assistant, user
#: What keeping a row leads to, by state and initial (s, u, a, another); -1: not allowed.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs behind a conversation's end: nothing, or an assistant last.
NEVER = 1 << 50
LAST = np.array([0, NEVER, NEVER, 0])
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows and bytes of a segment's buffer, and entries of one tensor.
ROWS, BYTES, CELLS = 8192, 1 << 23, 1 << 20
SPACES = " \t\n\x0b\x0c\r"
_SEGMENT = "conv_id long, part int, seq int, edge boolean, turns array<long>, roles array<string>, texts array<string>, letters array<tinyint>, faults array<tinyint>, h1 array<long>, h2 array<long>"
_EDIT = "array<struct<role: string, text: string>>"
_STATS = "blank long, duplicate long, truncated long, illegal long, head int, tail int, low long, high long, turns_seen long, cost long"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the damage that the crc32 of "conv_id:turn" gives them; a dropped row stays as gone.

    By the remainder of 20: 0 drops, 1 empties the text, 2 takes its .!? out, 3 repeats the row, 4 makes its role user. Nulls
    are one space in role, text and key.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("code"))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_")).drop("_")


def _described(rows: DataFrame) -> DataFrame:
    """rows with the role's initial, the fault that a row shows by itself, and two hashes of role and text."""
    first = F.substring("role", 1, 1)
    letter = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "gone", letter.cast("tinyint").alias("letter"), fault.cast("tinyint").alias("fault"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any column, null being a value of its own; the first row counts as different."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        value, null = pc.fill_null(c, 0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def segments(rows: DataFrame) -> DataFrame:
    """A row per segment with lists of its rows' values; edge: the conversation may go on in another segment. rows: `damaged`."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]

    def cut(batches):
        part, seq, open_, held, n, size = TaskContext.get().partitionId(), 0, True, [], 0, 0

        def flush(end: bool):
            nonlocal seq, open_, held, n, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            start = np.flatnonzero(_changes(whole.column("conv_id")))
            keep = [] if end or len(start) == 1 else [whole.slice(start[-1])]
            todo = len(start) - len(keep)
            at = np.append(start, len(whole))[: todo + 1]
            edge = np.zeros(todo, bool)
            edge[0] = open_
            open_ = end or not keep  # the last one is cut here, and what follows may go on with it
            edge[-1] |= open_
            rows = whole.slice(0, at[-1])
            alive = ~rows.column("gone").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(todo), np.diff(at))[alive]
            ids = rows.column("conv_id").take(pa.array(at[:-1]))
            rows = rows.filter(pa.array(alive))
            h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
            fault = rows.column("fault").to_numpy().copy()
            by = np.lexsort((h2, h1, of))  # stable: the earliest of equals first
            again = by[1:][(of[by[1:]] == of[by[:-1]]) & (h1[by[1:]] == h1[by[:-1]]) & (h2[by[1:]] == h2[by[:-1]])]
            fault[again[fault[again] != BLANK]] = DUPLICATE
            offsets = pa.array(np.searchsorted(of, np.arange(todo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (rows.column("turn"), rows.column("role"), rows.column("text"), rows.column("letter"), pa.array(fault), rows.column("h1"), rows.column("h2"))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(todo, part, np.int32)), pa.array(np.arange(seq, seq + todo, dtype=np.int32)), pa.array(edge), *lists], names=names)
            seq, held = seq + todo, keep
            n, size = sum(len(b) for b in held), 0

        for batch in batches:
            if len(batch):
                held.append(batch)
                n, size = n + len(batch), size + batch.nbytes
                if n >= ROWS or size >= BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h1"]
    return _described(rows).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(cut, _SEGMENT)


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs by state where any number of inserts may come first; three are as many as ever help."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[..., NEXT])
    return cost


def edit_costs(behind: np.ndarray, letter: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """The least costs of deleting, keeping and reroling one row of each conversation: (3, n, 4). behind: (n, 4), what follows."""
    to = KEPT.T[letter]
    more = np.where(fault == CUT, TRUNCATED, 0)[:, None] + np.where((fault == BLANK) | (fault == DUPLICATE), NEVER, 0)[:, None]
    keep = np.where(to >= 0, np.take_along_axis(behind, np.maximum(to, 0), 1) + KEEP + more, NEVER)
    return np.minimum(np.stack([DELETE + behind, keep, REROLE + more + behind[:, NEXT]]), NEVER)


def backward(letter: np.ndarray, fault: np.ndarray, n: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least costs from each turn and state on: (turns + 1, conversations, 4).

    letter, fault: (turns, conversations), of which the first n[k] turns of conversation k count. last: (conversations, 4), the costs behind the end.
    """
    cost = np.empty((len(letter) + 1, len(n), 4), np.int64)
    cost[-1] = inserted(last)
    for t in range(len(letter) - 1, -1, -1):
        now = inserted(edit_costs(cost[t + 1], letter[t], fault[t]).min(axis=0))
        cost[t] = np.where((t < n)[:, None], now, cost[t + 1])
    return cost


def trace(cost: np.ndarray, letter: np.ndarray, fault: np.ndarray, n: np.ndarray, last: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The edits of each conversation from its state on, the ASCII-least of the cheapest, and the state at its end.

    All conversations step together, one edit a step. Initials lead to one state each, so taking the least initial that
    keeps the cost gives the least text; no cheapest text is another's beginning, since every further edit costs.
    """
    k, at, q, audit = np.arange(len(n)), np.zeros(len(n), np.int64), state.copy(), []
    if not len(letter):  # no rows at all: one that none of the n reach
        letter = fault = np.zeros((1, len(n)), np.int8)
    while True:
        now = cost[at, k, q]
        over = (at == n) & (last[k, q] == now)
        if over.all():
            break
        t = np.minimum(at, len(letter) - 1)
        row = ~over & (at < n)
        delete, keep, rerole = (x[k, q] == now for x in edit_costs(cost[np.minimum(at + 1, len(cost) - 1), k], letter[t, k], fault[t, k]))
        insert = ~over & (INSERT + cost[at, k, NEXT[q]] == now)
        step = np.select([row & delete, insert, row & keep, row & rerole], [*b"DIKR"], 0).astype(np.uint8)
        audit.append(step)
        q = np.select([step == ord("K"), (step == ord("I")) | (step == ord("R"))], [KEPT[q, letter[t, k]], NEXT[q]], q)
        at = at + ((step > 0) & (step != ord("I")))
    lines = np.array(audit, np.uint8).reshape(len(audit), len(n)).T.copy()
    return [x.tobytes().rstrip(b"\0").decode() for x in lines], q


def buckets(n: np.ndarray) -> list[np.ndarray]:
    """Conversations of like length (within a factor of two), as many as a tensor may hold."""
    order, out = np.argsort(n, kind="stable"), []
    size = np.ceil(np.log2(np.maximum(n[order], 1))).astype(int)
    for s in np.unique(size):
        own = order[size == s]
        many = max(1, CELLS >> int(s))
        out += [own[a : a + many] for a in range(0, len(own), many)]
    return out


class Batch:
    """The segments of one Arrow batch: where each begins in the flat values, and these."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda c: batch.column(c).flatten()
        first = batch.column("letters").offsets.to_numpy().astype(np.int64)
        self.first = first - first[0]
        self.n = np.diff(self.first)
        self.letter, self.fault = flat("letters").to_numpy().astype(np.int64), flat("faults").to_numpy().copy()
        self.roles, self.texts, self.turns = flat("roles"), flat("texts"), flat("turns")
        if "late" in batch.schema.names:  # rows that an earlier segment has
            for k, late in enumerate(batch.column("late").to_pylist()):
                at = self.first[k] + np.array(late or [], np.int64)
                self.fault[at[self.fault[at] != BLANK]] = DUPLICATE

    def tensors(self):
        """Bucket by bucket: which segments, and their initials and faults by turn."""
        for own in buckets(self.n):
            t = np.arange(int(self.n[own].max()))[:, None]
            at = np.minimum(self.first[own] + t, max(0, len(self.letter) - 1))
            letter, fault = (x[at] if len(x) else np.zeros((len(t), len(own)), np.int8) for x in (self.letter, self.fault))
            yield own, letter, fault, self.n[own]

    def costs(self, last: np.ndarray) -> np.ndarray:
        """The least costs at each segment's begin by state."""
        out = np.empty((len(self.n), 4), np.int64)
        for own, letter, fault, n in self.tensors():
            out[own] = backward(letter, fault, n, last[own])[0]
        return out

    def edits(self, last: np.ndarray, entries: list[int]) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """Costs at the begin, and for each state of entry the edits of each segment and the state behind it."""
        cost0 = np.empty((len(self.n), 4), np.int64)
        audits, behind = [[""] * len(self.n) for _ in entries], np.zeros((len(self.n), len(entries)), np.int64)
        for own, letter, fault, n in self.tensors():
            cost = backward(letter, fault, n, last[own])
            cost0[own] = cost[0]
            for j, entry in enumerate(entries):
                if (cost[0, :, entry] >= NEVER).all():
                    continue
                reach = np.flatnonzero(cost[0, :, entry] < NEVER)
                texts, q = trace(cost[:, reach], letter[:, reach], fault[:, reach], n[reach], last[own[reach]], np.full(len(reach), entry))
                for k, text in zip(own[reach].tolist(), texts, strict=True):
                    audits[j][k] = text
                behind[own[reach], j] = q
        return cost0, audits, behind

    def repaired(self, audits: list[str], entry: np.ndarray) -> pa.Array:
        """The turns that each segment has after its edits."""
        letters = np.frombuffer("".join(audits).encode(), np.uint8)
        n = np.array([len(x) for x in audits], np.int64)
        of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        uses = letters != ord("I")
        before = np.concatenate([[0], np.cumsum(uses)])
        row = self.first[of] + before[:-1] - before[start][of]
        state = entry.astype(np.int64).copy()
        given = np.zeros(len(letters), np.int64)
        for t in range(int(n.max(initial=0))):  # the states along all segments' edits, a step at a time
            k = np.flatnonzero(n > t)
            at = start[k] + t
            given[at] = GIVEN[state[k]]
            step = letters[at]
            initial = self.letter[np.minimum(row[at], max(0, len(self.letter) - 1))] if len(self.letter) else np.zeros(len(at), np.int64)
            state[k] = np.select([step == ord("K"), step == ord("D")], [KEPT[state[k], initial], state[k]], NEXT[state[k]])
        stays = letters != ord("D")
        rows = len(self.roles)
        role = np.where(letters == ord("K"), row, rows + given)[stays]
        text = np.where(letters == ord("I"), rows, row)[stays]
        roles = pa.concat_arrays([self.roles, pa.array(["user", "assistant"], self.roles.type)]).take(pa.array(role))
        texts = pa.concat_arrays([self.texts, pa.array([""], self.texts.type)]).take(pa.array(text))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[stays], minlength=len(n)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([roles, texts], names=["role", "text"]))

    def stats(self) -> dict[str, pa.Array]:
        """Counts of faults and of illegal neighbours, the outer initials (-1: no rows), and the turns' range and number, by segment."""
        m, of = len(self.n), np.repeat(np.arange(len(self.n)), self.n)
        out = {name: np.bincount(of[self.fault == code], minlength=m) for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))}
        a, b = self.letter[:-1], self.letter[1:]
        wrong = ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))) & (of[1:] == of[:-1])
        out["illegal"] = np.bincount(of[1:][wrong], minlength=m)
        some = self.n > 0
        for name, at in (("head", self.first[:-1]), ("tail", self.first[1:] - 1)):
            out[name] = np.where(some, self.letter[np.clip(at, 0, max(0, len(of) - 1))] if len(of) else -1, -1)
        there = ~self.turns.is_null().to_numpy(zero_copy_only=False)
        turn, whose = pc.fill_null(self.turns, 0).to_numpy()[there], of[there]
        new = np.ones(len(turn), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (whose[1:] != whose[:-1])
        out["turns_seen"] = np.bincount(whose[new], minlength=m)
        lo, hi = np.searchsorted(whose, np.arange(m)), np.searchsorted(whose, np.arange(m), "right") - 1
        none = pa.array(lo > hi)
        for name, at in (("low", lo), ("high", hi)):
            value = turn[np.clip(at, 0, len(turn) - 1)] if len(turn) else np.zeros(m, np.int64)
            out[name] = pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(value))
        return {k: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int32 if k in ("head", "tail") else np.int64)) for k, v in out.items()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.replace("array<struct<role: string, text: string>>", "edits").split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _whole(rows: DataFrame) -> DataFrame:
    """The rows of conversations that one segment holds."""
    schema = f"conv_id long, {_STATS}, audit string, repaired {_EDIT}"

    def run(batches):
        for batch in batches:
            if len(batch):
                b = Batch(batch)
                cost, audits, _ = b.edits(np.tile(LAST, (len(b.n), 1)), [0])
                yield _batch(schema, conv_id=batch.column("conv_id"), cost=pa.array(cost[:, 0]), audit=pa.array(audits[0]), repaired=b.repaired(audits[0], np.zeros(len(b.n))), **b.stats())

    return rows.mapInArrow(run, schema)


def _matrices(rows: DataFrame) -> DataFrame:
    """The least costs of each segment from each state to each, row by row."""
    schema = "conv_id long, part int, seq int, matrix array<long>"

    def run(batches):
        for batch in batches:
            if len(batch):
                b = Batch(batch)
                unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
                m = np.stack([b.costs(np.tile(unit[j], (len(b.n), 1))) for j in range(4)], axis=2)
                yield _batch(schema, **{c: batch.column(c) for c in ("conv_id", "part", "seq")}, matrix=pa.array(list(m.reshape(-1, 16))))

    return rows.mapInArrow(run, schema)


def costs_behind(one: pd.DataFrame) -> pd.DataFrame:
    """One conversation's segments with the costs that follow each, from the last one back; the first one's costs are its own too."""
    one, last, out = one.sort_values(["part", "seq"]), LAST, []
    for m in one["matrix"].to_list()[::-1]:
        out.append(last)
        last = np.minimum((np.reshape(m, (4, 4)) + last).min(axis=1), NEVER)
    return pd.DataFrame({"part": one["part"], "seq": one["seq"], "last": [list(map(int, x)) for x in out[::-1]]})


def _traced(rows: DataFrame) -> DataFrame:
    """Each segment's edits, and the state behind it, for each state of entry."""
    schema = f"conv_id long, part int, seq int, {_STATS}, audits array<string>, behind array<long>"

    def run(batches):
        for batch in batches:
            if len(batch):
                b = Batch(batch)
                last = np.array(batch.column("last").to_pylist(), np.int64)
                cost, audits, behind = b.edits(last, [0, 1, 2, 3])
                yield _batch(schema, **{c: batch.column(c) for c in ("conv_id", "part", "seq")}, cost=pa.array(cost[:, 0]), audits=pa.array(list(zip(*audits, strict=True))), behind=pa.array(list(behind)), **b.stats())

    return rows.mapInArrow(run, schema)


def entered(one: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of a conversation is entered, and what only shows between segments: illegal neighbours, a turn in both."""
    one = one.sort_values(["part", "seq"], ignore_index=True)
    state, entry, illegal, shared, tail, high = 0, [], [], [], -1, None
    for head, own_tail, low, own_high, behind in zip(one["head"], one["tail"], one["low"], one["high"], one["behind"], strict=True):
        entry.append(state)
        state = int(behind[state])
        illegal.append(int(min(head, tail) >= 0 and (tail, head) not in {(0, 1), (1, 2), (2, 1)}))
        shared.append(int(low is not None and low == high))
        tail, high = (own_tail, own_high or high) if head >= 0 else (tail, high)
    return pd.DataFrame({"part": one["part"], "seq": one["seq"], "entry": np.array(entry, np.int64), "between": np.array(illegal, np.int64), "shared": np.array(shared, np.int64)})


def _applied(rows: DataFrame) -> DataFrame:
    schema = f"part int, seq int, repaired {_EDIT}"

    def run(batches):
        for batch in batches:
            if len(batch):
                entry = batch.column("entry").to_numpy()
                yield _batch(schema, part=batch.column("part"), seq=batch.column("seq"), repaired=Batch(batch).repaired(batch.column("audit").to_pylist(), entry))

    return rows.mapInArrow(run, schema)


def _joined(edges: DataFrame, work: Workspace) -> DataFrame:
    """The conversations whose segments lie at their tasks' edges or are runs of a long one, put together."""
    at = ["part", "seq"]
    each = edges.select("conv_id", *at, "faults", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h"))
    hashes = each.where(F.get("faults", "i") != DUPLICATE)
    first = F.min(F.struct(*at)).over(Window.partitionBy("conv_id", "h.h1", "h.h2"))  # at most a row for each segment
    late = hashes.select(*at, "i", first.alias("f")).where("f.part <> part OR f.seq <> seq").groupBy(*at).agg(F.collect_list("i").alias("late"))
    edges = work.table(edges.drop("h1", "h2").join(late, at, "left"), "edges")
    last = _matrices(edges).groupBy("conv_id").applyInPandas(costs_behind, "part int, seq int, last array<long>")
    traced = work.table(_traced(edges.join(last, at)), "traced")
    # whole numbers beside nulls pass as text: pandas would make them floats
    narrow = traced.select("conv_id", *at, "head", "tail", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "behind")
    chain = narrow.groupBy("conv_id").applyInPandas(entered, "part int, seq int, entry long, between long, shared long")
    chosen = work.table(traced.join(chain, at).withColumn("audit", F.get("audits", "entry")).drop("audits", "behind"), "chosen")
    texts = _applied(edges.join(chosen.select(*at, "audit", "entry"), at))
    rows = chosen.join(texts, at)
    whole = F.sort_array(F.collect_list(F.struct(*at, "audit", "repaired")))
    total = {c: F.sum(c) for c in ("blank", "duplicate", "truncated")} | {"illegal": F.sum(F.col("illegal") + F.col("between")), "low": F.min("low"), "high": F.max("high"), "turns_seen": F.sum(F.col("turns_seen") - F.col("shared")), "cost": F.min_by("cost", F.struct(*at))}
    found = rows.groupBy("conv_id").agg(*[x.alias(c) for c, x in total.items()], whole.alias("s"))
    return found.select("conv_id", *total, F.array_join("s.audit", "").alias("audit"), F.flatten("s.repaired").alias("repaired"))


def gaps(low: Column, high: Column, seen: Column) -> Column:
    """How many turns between the least and the greatest are missing; the greatest long where there are more."""
    wide = F.greatest(high.cast("decimal(20,0)") - low.cast("decimal(20,0)") + 1 - seen, F.lit(0))
    return F.coalesce(F.least(wide, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long"), F.lit(0).cast("long"))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (the turns after the edits): a row per conversation of rows.

    rows: conv_id, turn, role, text, gone (a row that only says that its conversation exists), as `damaged` gives them;
    other columns are not read. A null conv_id is a conversation of its own. Null turns come first; rows of equal turn go by role, then by a
    hash of role and text, and equal rows by chance, which changes nothing. A role of another initial, or an empty one, can't be
    kept. A conversation without rows has zeros, no edits and no turns. An empty table gives no rows. The result's row for a
    conversation holds its turns: it must fit in a row of Spark (2 GB); nothing before that holds a conversation whole.
    """
    work = Workspace(rows.sparkSession, "conversations")
    cut = work.table(segments(rows), "segments")
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns_seen", "cost", "audit", "repaired"]
    done = [_whole(cut.where("not edge")).select(*names), _joined(cut.where("edge"), work).select(*names)]
    missing = gaps(F.col("low"), F.col("high"), F.col("turns_seen"))
    return reduce(DataFrame.unionByName, done).select("conv_id", missing.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
