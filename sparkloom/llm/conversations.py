"""Conversation structure repair: the cheapest edits that give a conversation its turn order, by dynamic programming over turns.

Turns of many conversations stand side by side in NumPy tensors, turn by turn: conversations are bucketed by length,
backward costs of the four states of ``(s?(ua)+)?`` are worked out for a whole bucket per turn and stored, and the edits
are traced forward the same way. Rows lie in one global order, cut into pieces of bounded size; a conversation that
crosses pieces is joined by the cost matrices and state maps of its parts, so that none is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated turn adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a piece, as a power of two.
PIECE_BITS = 12
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. What follows an inserted or re-roled turn.
NEXT = np.array([2, 2, 3, 2])
#: State after keeping a turn whose role starts with s, u, a or another letter; 4 where it may not stay.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: Turns still to insert at the end, as costs.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
NEVER = np.int64(1 << 60)
#: Initials in code order; faults in the order in which the first one counts.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
PAD = 255

EDITS = "conv_id long, turn long, at long, h binary, initial string, fault string, edit string, before string, after string, role string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("h", pa.binary()), ("initial", pa.string()), ("fault", pa.string()), ("edit", pa.string()), ("before", pa.string()), ("after", pa.string()), ("role", pa.string())])
PARTS = "conv_id long, chunk long, side int, codes binary, matrix array<long>"
NOTES = "conv_id long, chunk long, side int, codes binary, ahead array<long>, closing boolean"
MOVES = f"{NOTES}, exits array<int>"
ENTRIES = "chunk long, side int, ahead array<long>, closing boolean, entry int"
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- tensors: codes (turns, conversations), costs (turns + 1, conversations, states)


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from each turn and state to the end; ends has a row of costs for each conversation."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = ends
    padded = np.full((n, 5), NEVER)
    for t in range(turns - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        padded[:, :4] = after
        kept = np.take_along_axis(padded, KEEP[code & 3], axis=1)
        stay = np.minimum(kept, after[:, NEXT] + REROLE) + np.where(code >> 2 == 3, TRUNCATED, 0)[:, None]
        here = np.where(((code >> 2) % 3 == 0)[:, None], np.minimum(after + DELETE, stay), after + DELETE)
        u, a = here[:, 2].copy(), here[:, 3].copy()
        here[:, 2] = np.minimum(u, a + INSERT)
        here[:, 3] = np.minimum(a, u + INSERT)
        here[:, :2] = np.minimum(here[:, :2], here[:, 2:3] + INSERT)
        costs[t] = np.where((code == PAD)[:, None], after, np.minimum(here, NEVER))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edit, state before inserts, inserts) of each turn, and the last state: at each step the ASCII-least edit that is among the cheapest."""
    turns, n = codes.shape
    edits, states, inserts = np.full((turns, n), ord("."), np.uint8), np.zeros((turns, n), np.int8), np.zeros((turns, n), np.int8)
    every, state = np.arange(n), entry.astype(np.int64)
    for t in range(turns):
        code, here, after = codes[t], costs[t], costs[t + 1]
        live = code != PAD
        states[t] = state
        for _ in range(2):
            left = here[every, state]
            more = live & (after[every, state] + DELETE != left) & (here[every, NEXT[state]] + INSERT == left)
            inserts[t] += more
            state = np.where(more, NEXT[state], state)
        left, truncated = here[every, state], np.where(code >> 2 == 3, TRUNCATED, 0)
        dropped = after[every, state] + DELETE == left
        to = KEEP[code & 3, state]
        kept = ~dropped & (to < 4) & (after[every, np.minimum(to, 3)] + truncated == left)
        edits[t] = np.where(live, np.where(dropped, ord("D"), np.where(kept, ord("K"), ord("R"))), ord("."))
        state = np.where(~live | dropped, state, np.where(kept, np.minimum(to, 3), NEXT[state]))
    return edits, states, inserts, state


def buckets(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(turns, conversations) with lengths above half the turns, up to them."""
    tops = np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), 1)
    for top in np.unique(tops):
        yield int(top), np.flatnonzero(tops == top)


def tensor(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of some runs, turn-major, and the place of each in the flat array; -1 and PAD beyond a run's end."""
    places = starts[None, :] + np.arange(turns)[:, None]
    places = np.where(np.arange(turns)[:, None] < lengths[None, :], places, -1)
    return np.where(places >= 0, codes[places], PAD).astype(np.uint8), places


def matrix(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before a run to each state after it."""
    ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return backward(np.repeat(codes[:, None], 4, axis=1), ends)[0].T


# ---- columns


def _damaged(conversations: DataFrame) -> DataFrame:
    """The rows before copies of them are made, with ``copies``."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    text, kind = F.coalesce("text", blank), F.crc32(key) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role by crc32 of ``conv_id:turn``; a null is one space there, and in role and text."""
    return _copied(_damaged(conversations))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _key() -> Column:
    """The conversation, role and text of a turn as one hash."""
    parts = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.unhex(F.sha2(parts, 256))


def _body() -> Column:
    return F.rtrim(F.col("text"), F.lit(SPACE))


def _in_order(rows: DataFrame) -> DataFrame:
    """Turns without texts in one global order, (conv_id, turn, role, text), with their place ``at``; written once, so that places hold."""
    cut = F.substring(F.col("text"), 1, 64)
    light = rows.select("conv_id", "turn", F.substring("role", 1, 64).alias("r"), cut.alias("t"), _key().alias("h"), F.substring("role", 1, 1).alias("initial"), (_body() == "").alias("blank"), (~F.substring(_body(), -1, 1).isin(".", "!", "?")).alias("cut"))
    order = ["conv_id", "turn", "r", "t"]
    placed = light.repartitionByRange(*order).sortWithinPartitions(*order, "h").select("conv_id", "turn", F.monotonically_increasing_id().alias("at"), "h", "initial", "blank", "cut")
    return written(placed, "turns")


def _coded(placed: DataFrame) -> DataFrame:
    """With ``code``: initial and first fault. Copies are told by the first place of each key, so that a hot one is pre-aggregated."""
    first = placed.where("not blank").groupBy("h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.coalesce(F.when(F.col("initial") != "", F.instr(F.lit(INITIALS), F.col("initial"))), F.lit(0))
    code = F.when(initial > 0, initial - 1).otherwise(3) + 4 * fault
    joined = placed.join(first, "at", "left")
    return written(joined.select("conv_id", "turn", "at", "h", "initial", code.cast("int").alias("code"), F.shiftright("at", PIECE_BITS).alias("chunk")), "codes")


def _runs(conv: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal conversations of a piece."""
    null = conv.is_null().to_numpy()
    ids = pc.fill_null(conv, 0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
    return starts, np.diff(np.append(starts, len(ids)))


def _parts(piece: pa.Table) -> pa.Table:
    """The first and the last run of a piece, which may go on beyond it, with their cost matrices."""
    piece = piece.sort_by("at")
    starts, lengths = _runs(piece["conv_id"])
    codes = piece["code"].to_numpy().astype(np.uint8)
    rows = []
    for side, k in enumerate(sorted({0, len(starts) - 1})):
        own = codes[starts[k] : starts[k] + lengths[k]]
        rows.append({"conv_id": piece["conv_id"][starts[k]].as_py(), "chunk": piece["chunk"][0].as_py(), "side": side, "codes": own.tobytes(), "matrix": matrix(own).ravel().tolist()})
    return pa.Table.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("side", pa.int32()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64()))]))


_START = object()


def _look_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come from the last to the first: the costs that lie ahead of each."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("side", pa.int32()), ("codes", pa.binary()), ("ahead", pa.list_(pa.int64())), ("closing", pa.bool_())])
    last, ahead = _START, END
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["closing"] = last is _START or r["conv_id"] != last
            ahead, last = END if r["closing"] else ahead, r["conv_id"]
            r["ahead"] = ahead.tolist()
            ahead = np.minimum(NEVER, (np.array(r.pop("matrix"), np.int64).reshape(4, 4) + ahead[None, :]).min(axis=1))
        yield pa.RecordBatch.from_pylist(rows, schema)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each part, for each state before it."""
    for batch in batches:
        exits = []
        for codes, ahead in zip(batch.column("codes").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
            four = np.repeat(np.frombuffer(codes, np.uint8)[:, None], 4, axis=1)
            exits.append(trace(four, backward(four, np.array([ahead] * 4)), np.arange(4))[3].tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exits, pa.list_(pa.int32()))], names=[*batch.schema.names, "exits"])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come from the first to the last: the state in which each begins."""
    schema = pa.schema([("chunk", pa.int64()), ("side", pa.int32()), ("ahead", pa.list_(pa.int64())), ("closing", pa.bool_()), ("entry", pa.int32())])
    last, state = _START, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            state = 0 if last is _START or r["conv_id"] != last else state
            rows.append({"chunk": r["chunk"], "side": r["side"], "ahead": r["ahead"], "closing": r["closing"], "entry": state})
            state, last = r["exits"][state], r["conv_id"]
        yield pa.RecordBatch.from_pylist(rows, schema)


#: Roles that inserts give from a state on.
_FROM = {s: ("", "a", "au") if s == 2 else ("", "u", "ua") for s in range(4)}
_BEFORE = np.array([_FROM[s] for s in range(4)], object)
_AFTER = np.array(["", "ua", "a", ""], object)


def _edits(piece: pa.Table, notes: pa.Table) -> pa.Table:
    """The edits of all turns of a piece; its outer runs take what lies ahead of them and their first state from the notes."""
    piece = piece.sort_by("at")
    starts, lengths = _runs(piece["conv_id"])
    codes, n = piece["code"].to_numpy().astype(np.uint8), piece.num_rows
    ends, entry, closing = np.repeat(END[None, :], len(starts), axis=0), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for note in notes.to_pylist():
        k = 0 if note["side"] == 0 else len(starts) - 1
        ends[k], entry[k], closing[k] = note["ahead"], note["entry"], note["closing"]
    edits, before, after, role = np.zeros(n, np.uint8), np.full(n, "", object), np.full(n, "", object), np.full(n, None, object)
    for turns, some in buckets(lengths):
        codes_, places = tensor(codes, starts[some], lengths[some], turns)
        made, states, inserts, last = trace(codes_, backward(codes_, ends[some]), entry[some])
        live = places >= 0
        at = places[live]
        edits[at], before[at] = made[live], _BEFORE[states[live], inserts[live]]
        now = np.where(inserts % 2 == 1, NEXT[states], np.where(inserts == 2, NEXT[NEXT[states]], states))
        role[at] = np.where(made[live] == ord("R"), np.where(now[live] == 2, "assistant", "user"), None)
        after[(starts + lengths - 1)[some]] = np.where(closing[some], _AFTER[last], "")
    letters = np.array([chr(i) for i in range(128)], object)[edits]
    faults = np.array(FAULTS, object)[codes >> 2]
    return pa.Table.from_arrays([piece["conv_id"], piece["turn"], piece["at"], piece["h"], piece["initial"], *[pa.array(x, pa.string()) for x in (faults, letters, before, after, role)]], schema=_EDITS)


def plan_edits(rows: DataFrame) -> DataFrame:
    """One row a turn, (conv_id, turn, at, h, initial, fault, edit, before, after, role): the cheapest edits, of equally cheap ones the ASCII-least.

    Rows have conv_id, turn, role and text without nulls in the last two. Turns go by turn, nulls first, then role and
    text (by their first 64 characters, then by hash). ``edit`` is K, R or D; ``before`` and ``after`` name the roles
    inserted around the turn by their initials, ``role`` is the new one of R. A null conv_id is a conversation.
    """
    coded = _coded(_in_order(rows))
    parts = coded.select("conv_id", "chunk", "at", "code").groupBy("chunk").applyInArrow(_parts, PARTS)
    ahead = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"), F.desc("side")).mapInArrow(_look_ahead, NOTES)
    moves = ahead.repartition("chunk").mapInArrow(_exits, MOVES)
    entries = moves.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "side").mapInArrow(_enter, ENTRIES)
    return coded.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(_edits, EDITS)


def repair(rows: DataFrame) -> DataFrame:
    """plan_edits() with the ``text`` and the ``old_role`` of the turns that stay; deleted turns have neither. Written to the shared folder.

    Copies of a turn are deleted, so each key has one turn that stays, and meets its text in a join on that key alone.
    """
    return _with_texts(rows, rows)


def _with_texts(rows: DataFrame, once: DataFrame) -> DataFrame:
    """once has each row of rows at least one time."""
    edits = written(plan_edits(rows), "edits")
    texts = once.where(_body() != "").select(_key().alias("h"), F.col("role").alias("old_role"), "text").groupBy("h").agg(F.first("old_role").alias("old_role"), F.first("text").alias("text"))
    kept = edits.where("edit != 'D'").join(texts, "h", "left")
    return kept.unionByName(edits.where("edit = 'D'"), allowMissingColumns=True).drop("h")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, place, role, text), place counting from 0; inserted turns have empty texts.

    Nulls in role and text are one space. Empty table: empty result. Turns without a [.!?] at their end stay as they are.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("role", "old_role").alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    made = repair(rows).select("conv_id", "at", F.posexplode(F.concat(named(F.col("before")), own, named(F.col("after")))).alias("k", "x"))
    return made.select("conv_id", (F.col("at") * 8 + F.col("k")).alias("place"), "x.role", "x.text")


# ---- digests


class _Digest:
    """What the rows of one conversation, in order, come to; holds one row and the audit."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.sha, self.audit, self.lines = conv_id, hashlib.sha256(), [], 0
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None

    def line(self, role: str, text: str) -> None:
        self.sha.update(b"\n" if self.lines else b"")
        self.sha.update(role.encode())
        self.sha.update(b":")
        self.sha.update(text.encode())
        self.lines += 1

    def add(self, r: dict) -> None:
        self.counts[r["fault"]] += 1
        self.illegal += self.initial is not None and self.initial + r["initial"] not in ("su", "ua", "au")
        self.initial = r["initial"]
        if r["turn"] is not None and r["turn"] != self.last:
            self.first = r["turn"] if self.first is None else self.first
            self.last, self.turns = r["turn"], self.turns + 1
        for where in ("before", "edit", "after"):
            if where == "edit":
                self.audit.append(r["edit"])
                if r["edit"] == "D":
                    self.cost += DELETE
                else:
                    self.cost += (TRUNCATED if r["fault"] == "truncated" else 0) + (REROLE if r["edit"] == "R" else 0)
                    self.line(r["role"] or r["old_role"], r["text"])
            else:
                for c in r[where]:
                    self.audit.append("I")
                    self.cost += INSERT
                    self.line("user" if c == "u" else "assistant", "")

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **{f: self.counts[f] for f in FAULTS[1:]}, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, done = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            for r in batch.slice(lo, 512).to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    done += [now.row()] if now else []
                    now = _Digest(r["conv_id"])
                now.add(r)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def audit(conversations: DataFrame) -> DataFrame:
    """Damage, faults, edits and repaired hash of each conversation of the table: (conv_id, gaps, blank, ..., repaired_sha256).

    The hash of a conversation is sequential by nature: its turns stream through one task in order, a row at a time;
    everything else is spread over pieces of the global order. A conversation without a row after damage has zeros, an
    empty audit and the hash of the empty string. Repeated rows are duplicates of each other. Empty table: empty result.
    """
    rows = _damaged(conversations)
    made = _with_texts(_copied(rows), rows.drop("copies"))
    digests = made.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_digests, DIGESTS).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    joined = every.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
