"""Repair of conversations by the cheapest edits, and of these the ASCII-least, found by prefix-doubling path ranking.

Rows of a conversation are edited in order until their roles read
``(s?(ua)+)?`` by initials: Keep costs 0, Rerole to user or assistant 1, Delete
2, Insert of an empty user or assistant row 5; blank and duplicate rows have to
be deleted, a truncated row that stays costs 5 more. A node is a place before
a row (or the end) and what was put out so far (nothing, s, u, a); each edit is
an arc. The DP gives each node the cost of the cheapest way to the end. Of the
arcs that lie on a cheapest way (the optimal ones) the one with the least
initial is a node's rank of length one, and its end the node's pointer; arcs of
one initial from one node lead to one node, as the grammar leaves one role
open. Ranks of length 2k are ranks of pairs (rank of a node, rank of the node
k edits on), pointers of k edits are followed twice, until all pointers stand
at the end. The least audit of a node is then read off by its doubled pointers.

A conversation is cut into segments of SEGMENT rows, of which only a sign a row
travels: the DP of a segment is a table of four by four costs, and a segment
that knows the costs at its end is ranked alone, for each way of entering it.
Only these tables, one for SEGMENT rows, meet by conversation, less than its
audit takes, which by contract is one value. The texts are sorted over the
cluster once, and stream past the audit once, row by row, into a running hash;
no task holds a conversation's texts.

Edge cases. A null conv_id is a conversation, null turns come first and count
no gaps, a null role or text is one space (so such a text is blank, and such a
role is no role). Rows of one turn are ordered by role and text. Rows that
repeat role and text are duplicates of the first. A conversation all of whose
rows go has an empty audit and the hash of nothing. Roles are told by their
first letters. An empty table gives an empty table. Further columns are left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .ordering import numbered

#: Rows of a segment, and rows that are ranked at a time.
SEGMENT, AT_ONCE = 1024, 1 << 15

#: White space between words, fixed by the contracts.
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = ".!?"

#: Signs of rows: blank, duplicate, then the role's initial, in capitals if truncated; o is any other role.
ROWS = "bdsuaoSUAO"
#: What was put out last: nothing, s, u or a. Where an inserted row, or one with a new role, leads from there.
STATES = 4
_NEXT = np.array([2, 2, 3, 2])
#: Edits in ASCII order; what an insert costs; no way.
EDITS = "DIKR"
_INSERT, _NEVER = 5, 1 << 40
#: Costs at the end of a conversation: what has to be inserted yet.
END = np.array([0, 10, 5, 0])


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Where an edit leads and what it costs, by edit, row sign and state; -1 where it does not apply. Inserts are apart, as they pass no row."""
    to, cost = np.full((4, len(ROWS), STATES), -1), np.zeros((4, len(ROWS)), "i8")
    for i, sign in enumerate(ROWS):
        to[0, i], cost[0, i] = np.arange(STATES), 2
        if sign in "bd":
            continue
        late = 5 * sign.isupper()
        to[3, i], cost[3, i] = _NEXT, 1 + late
        role, cost[2, i] = sign.lower(), late
        if role == "s":
            to[2, i, 0] = 1
        elif role in "ua":
            on = _NEXT == (2 if role == "u" else 3)
            to[2, i, on] = _NEXT[on]
    return to, cost


_TO, _COST = _arcs()


def _laid(rows: list[str]) -> np.ndarray:
    """Row signs as numbers, a segment a row, flush right; -1 before."""
    out = np.full((len(rows), max(map(len, rows), default=0)), -1)
    for i, r in enumerate(rows):
        if r:
            out[i, -len(r) :] = [ROWS.index(c) for c in r]
    return out


def costs(rows: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost of the cheapest way to the end from each node: segment, place, state. end: costs there, by segment and state."""
    n, width = rows.shape
    out = np.empty((n, width + 1, STATES), "i8")
    out[:, width] = end
    at = np.arange(n)[:, None]
    for j in range(width - 1, -1, -1):
        sign, on = rows[:, j], out[:, j + 1]
        best = np.full((n, STATES), _NEVER)
        for edit in (0, 2, 3):
            to = _TO[edit, sign]
            best = np.minimum(best, np.where(to >= 0, on[at, to] + _COST[edit, sign][:, None], _NEVER))
        for _ in range(2):  # two inserts in a row at most
            best = np.minimum(best, _INSERT + best[:, _NEXT])
        out[:, j] = np.minimum(best, _NEVER)
    return out


def ranked(rows: list[str], end: np.ndarray, entries: list[list[int]]) -> tuple[list[list[str]], list[list[int]], np.ndarray]:
    """Least audits of segments for each state of entries, the states in which they end, and the costs at the segments' beginning."""
    laid = _laid(rows)
    n, width = laid.shape
    cost = costs(laid, end)
    node = np.arange(n * (width + 1) * STATES).reshape(cost.shape)
    sign = np.concatenate([laid, np.full((n, 1), -1)], 1)[:, :, None]
    state = np.arange(STATES)
    ahead = np.concatenate([node[:, 1:], node[:, -1:]], 1)
    keys, ends = [], []
    for edit, name in enumerate(EDITS):
        to = np.broadcast_to(_NEXT, cost.shape) if name == "I" else np.where(sign >= 0, _TO[edit, sign, state], -1)
        target = np.take_along_axis(node if name == "I" else ahead, np.maximum(to, 0), 2)
        weight = _INSERT if name == "I" else _COST[edit, sign]
        live = (sign >= 0) & (to >= 0) & (cost.reshape(-1)[target] + weight == cost)
        keys.append(np.where(live, edit + 1, len(EDITS) + 1).reshape(-1))
        ends.append(target.reshape(-1))
    choice = np.argmin(keys, 0)
    rank = np.min(keys, 0)
    done = rank > len(EDITS)  # ends, and nodes before a segment's first row
    letter = np.where(done, 0, rank)
    pointer = np.where(done, node.reshape(-1), np.array(ends)[choice, np.arange(node.size)])
    rank, size, doubled = letter, (~done).astype("i8"), [pointer]
    while not done[pointer].all():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        size = size + size[pointer]
        pointer = pointer[pointer]
        doubled.append(pointer)
    size = size + size[pointer]
    first = [width - len(r) for r in rows]
    begin = np.array([node[i, first[i], s] for i, e in enumerate(entries) for s in e], "i8")
    of = np.repeat(np.arange(len(begin)), size[begin])
    place = np.arange(len(of)) - np.repeat(np.cumsum(size[begin]) - size[begin], size[begin])
    there = begin[of]
    for bit, pointers in enumerate(doubled):
        there = np.where(place >> bit & 1, pointers[there], there)
    told = np.frombuffer(b"?" + EDITS.encode(), "u1")[letter[there]].tobytes().decode()
    cuts = np.cumsum(size[begin])
    audits = iter([told[b - s : b] for b, s in zip(cuts.tolist(), size[begin].tolist(), strict=True)])
    outs = iter((pointer[begin] % STATES).tolist())
    return [[next(audits) for _ in e] for e in entries], [[next(outs) for _ in e] for e in entries], cost[np.arange(n), first]


def _dealt(rows: pd.Series) -> Iterator[np.ndarray]:
    """Places of segments of about one length, AT_ONCE rows or so at a time."""
    sizes = rows.str.len().to_numpy()
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        room = np.arange(1, len(order) - lo + 1) * (sizes[order[lo:]] + 1)
        hi = lo + max(1, int(np.searchsorted(room, AT_ONCE, "right")))
        yield order[lo:hi]
        lo = hi


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cost of each segment from each state at its beginning to each at its end."""
    ends = np.where(np.eye(STATES) == 1, 0, _NEVER)
    for batch in batches:
        out: list = [None] * len(batch)
        for some in _dealt(batch["codes"]):
            rows = batch["codes"].iloc[some].tolist()
            laid = _laid(rows)
            at, first = np.arange(len(rows)), laid.shape[1] - np.array([len(r) for r in rows])
            table = np.stack([costs(laid, np.tile(e, (len(rows), 1)))[at, first] for e in ends], 2)
            for i, m in zip(some, table, strict=True):
                out[i] = m.reshape(-1)
        yield pd.DataFrame({"grp": batch["grp"], "seg": batch["seg"], "m": out})


def _ends(tables: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each segment of a conversation, from the last backward."""
    tables = tables.sort_values("seg", ascending=False)
    end, out = END, []
    for m in tables["m"]:
        out.append(end)
        end = np.minimum((np.asarray(m).reshape(STATES, STATES) + end).min(1), _NEVER)
    return pd.DataFrame({"grp": tables["grp"], "seg": tables["seg"], "ends": out})


def _entries(exits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of a conversation is entered, from the first on."""
    exits = exits.sort_values("seg")
    state, out = 0, []
    for e in exits["exits"]:
        out.append(state)
        state = int(e[state if len(e) > 1 else 0])
    return pd.DataFrame({"grp": exits["grp"], "seg": exits["seg"], "entry": out})


def _rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audits and exits of segments, for each state of entry; the first of a conversation is entered with nothing put out."""
    for batch in batches:
        out: list = [None] * len(batch)
        for some in _dealt(batch["codes"]):
            part = batch.iloc[some]
            entries = [[0] if s == 0 else [0, 1, 2, 3] for s in part["seg"]]
            audits, exits, cost = ranked(part["codes"].tolist(), np.stack(part["ends"].to_list()), entries)
            for row in zip(some, audits, exits, cost[:, 0].tolist(), strict=True):
                out[row[0]] = row[1:]
        audits, exits, cost = zip(*out, strict=True) if out else ((), (), ())
        yield pd.DataFrame({"grp": batch["grp"], "seg": batch["seg"], "n_segs": batch["n_segs"], "codes": batch["codes"], "audits": audits, "exits": exits, "cost": cost})


#: Inserts that finish a conversation, by the state it ends in.
_TAIL = ("", "II", "I", "")
_RANKED = "grp string, seg bigint, n_segs bigint, codes string, audits array<string>, exits array<int>, cost bigint"
_REPORT = "grp string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """What a conversation's rows add up to as they stream past."""

    def __init__(self, grp: str):
        self.grp, self.faults, self.illegal, self.cost = grp, {"b": 0, "d": 0, "t": 0}, 0, 0
        self.low = self.high = self.initial = None
        self.turns, self.state, self.hash, self.lines = 0, 0, hashlib.sha256(), 0
        self.audits: list[str] = []
        self.left = self.codes = iter("")

    def segment(self, audit: str, codes: str, cost: int) -> None:
        self.flush()
        self.cost = cost if not self.audits else self.cost  # at its first segment
        self.audits.append(audit)
        self.left, self.codes = iter(audit), iter(codes)

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def new_role(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def flush(self) -> None:
        for _ in self.left:  # inserts behind the last row
            self.put(self.new_role(), "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        code = next(self.codes)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if (kind := "t" if code.isupper() else code) in self.faults:
            self.faults[kind] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for edit in self.left:
            if edit == "I":
                self.put(self.new_role(), "")
                continue
            if edit == "K":
                self.state = "sua".index(role[0]) + 1
                self.put(role, text)
            elif edit == "R":
                self.put(self.new_role(), text)
            break

    def report(self) -> tuple:
        self.flush()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.grp, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audits), self.hash.hexdigest()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and rows in order, conversation by conversation."""
    now: _Conversation | None = None
    schema = pa.schema([(c, pa.string() if c in ("grp", "audit", "repaired_sha256") else pa.int64()) for c in (x.split(" ")[0] for x in _REPORT.split(", "))])
    for batch in batches:
        done = []
        for grp, cost, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.grp != grp:
                done += [now.report()] if now else []
                now = _Conversation(grp)
            if cost is None:
                now.row(turn, role, text)
            else:
                now.segment(text, role, cost)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema) if done else pa.RecordBatch.from_pylist([], schema)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(now.report(), schema, strict=True)], schema=schema)


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (one space for null), damaged by the hash of conv_id and turn."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = chats.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _group(conv: Column) -> Column:
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def coded(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order (grp, turn, role, text, idx, n) and the signs of what they are (grp, idx, n, code)."""
    rows = chats.select(_group(F.col("conv_id")).alias("grp"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = numbered(rows, "grp", [F.col("turn").asc_nulls_first(), "role", "text"])
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    sign = F.when(stripped == "", "b").when(F.right(stripped, F.lit(1)).isin(*_ENDS), initial).otherwise(F.upper(initial))
    rows = rows.withColumn("sign", sign)
    same = F.sha2(F.concat_ws(":", F.octet_length("grp"), "grp", F.octet_length("role"), "role", "text"), 256)
    firsts = rows.where("sign <> 'b'").groupBy("grp", same.alias("same")).agg(F.min("idx").alias("idx")).select("grp", "idx", F.lit(True).alias("first"))
    marks = rows.select("grp", "idx", "n", "sign").join(firsts, ["grp", "idx"], "left")
    code = F.when((F.col("sign") != "b") & F.col("first").isNull(), "d").otherwise(F.col("sign"))
    return rows, marks.select("grp", "idx", "n", code.alias("code"))


def audits(codes: DataFrame) -> DataFrame:
    """grp, seg, codes, audit, cost (at the first segment, of the whole conversation), from grp, idx, n, code."""
    part = F.expr(f"idx div {SEGMENT}")
    listed = F.array_sort(F.collect_list(F.struct("idx", "code")))
    segments = codes.groupBy("grp", part.alias("seg")).agg(F.max("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes"))
    segments = settle(segments.withColumn("n_segs", F.expr(f"(n - 1) div {SEGMENT} + 1")).drop("n"))
    many = segments.where("n_segs > 1")
    tables = many.select("grp", "seg", "codes").mapInPandas(_tables, "grp string, seg bigint, m array<bigint>")
    ends = tables.groupBy("grp").applyInPandas(_ends, "grp string, seg bigint, ends array<bigint>")
    whole = segments.where("n_segs = 1").withColumn("ends", F.array(*(F.lit(int(x)).cast("bigint") for x in END)))
    told = settle(whole.unionByName(many.join(ends, ["grp", "seg"])).mapInPandas(_rank, _RANKED))
    entries = told.where("n_segs > 1").select("grp", "seg", "exits").groupBy("grp").applyInPandas(_entries, "grp string, seg bigint, entry int")
    met = told.where("n_segs > 1").join(entries, ["grp", "seg"]).unionByName(told.where("n_segs = 1").withColumn("entry", F.lit(0)))
    at = F.when(F.size("audits") == 1, 0).otherwise(F.col("entry"))
    tail = F.when(F.col("seg") == F.col("n_segs") - 1, F.element_at(F.array(*(F.lit(t) for t in _TAIL)), F.get("exits", at) + 1)).otherwise("")
    return met.select("grp", "seg", "codes", F.concat(F.get("audits", at), tail).alias("audit"), "cost")


def repair(chats: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of chats (conv_id, turn, role, text); every: conversations to tell, with rows or without."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    rows, codes = coded(chats)
    plans = audits(codes).select("grp", (F.col("seg") * SEGMENT).alias("idx"), "cost", F.col("codes").alias("role"), F.col("audit").alias("text"))
    both = rows.select("grp", "idx", "turn", "role", "text").unionByName(plans, allowMissingColumns=True)
    both = both.repartition("grp").sortWithinPartitions("grp", "idx", F.col("cost").asc_nulls_last())  # a segment's plan before its rows
    told = both.select("grp", "cost", "turn", "role", "text").mapInArrow(_stream, _REPORT)
    names = (every or chats).select(_group(F.col("conv_id")).alias("grp")).distinct()
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    conv = F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).cast(kind)
    return names.join(told, "grp", "left").fillna(zeros).select(conv.alias("conv_id"), *zeros)
