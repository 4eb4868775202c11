"""Repair of conversations at least cost: a cost DP over turns, then the ASCII-least audit among the cheapest by ranks of
doubled path prefixes. Conversations lie in pieces, so that one of any size is spread over tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, drop_staged, stage

#: A piece ends at so many turns or characters.
PIECE_TURNS, PIECE_CHARS = 4096, 4 << 20
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. What follows a state by role initial, and by an edit that
#: makes the role: user after all states but user.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
MADE = (USER, USER, ASSISTANT, USER)
#: Cost and edits that finish a conversation from a state.
ENDING, ENDS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: A row's code: its role initial (s, u, a or another), whether it must go, whether it is truncated.
INITIALS = "sua"
MUST, CUT = 4, 8


def _row_costs(code: int) -> np.ndarray:
    """Least cost over a row from each state to each, with what is inserted before it."""
    out = np.full((4, 4), FAR)
    for q in range(4):
        out[q, q] = DELETE
        if not code & MUST:
            extra = TRUNCATED if code & CUT else 0
            out[q, MADE[q]] = min(out[q, MADE[q]], REROLE + extra)
            if (to := _kept(code, q)) is not None:
                out[q, to] = min(out[q, to], KEEP + extra)
    one, two = out[list(MADE)] + INSERT, out[[MADE[q] for q in MADE]] + 2 * INSERT
    return np.minimum(np.minimum(out, np.minimum(one, two)), FAR)


def _kept(code: int, q: int) -> int | None:
    return AFTER[INITIALS[code & 3]][q] if code & 3 < 3 else None


COSTS = np.stack([_row_costs(code) for code in range(16)])


def _across(codes: bytes) -> list[int]:
    """Least cost over a piece from each state to each, row by row."""
    d = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code in reversed(codes):
        d = np.minimum((COSTS[code][:, :, None] + d[None]).min(1), FAR)
    return d.ravel().tolist()


def _least_paths(pieces: list[tuple[bytes, list[int]]], states: list[Iterable[int]]) -> list[tuple[list[int], list[str]]]:
    """Of pieces (codes, least costs after the piece by state) and each of some states at their beginning, the state at their
    end and the audit of the ASCII-least of the cheapest ways.

    Nodes are (place, state). Arcs of the cheapest ways carry the initials D, I, K, R in ASCII order. rank orders nodes by
    the least audits of 1, 2, 4, ... initials that lead on from them, and jump[k] leads 2 ** k arcs on: a node's rank at
    twice the length is that of (its rank, the rank where its jump ends). A node's way goes by the arc with the least
    (initial, rank of its end); a node has one arc for an initial at most, as state and initial settle what is put out.
    """
    begins = np.cumsum([0, *[4 * (len(codes) + 1) for codes, _ in pieces]])
    n = int(begins[-1])
    code, cost, last = np.zeros(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    for (codes, after), b in zip(pieces, begins.tolist(), strict=False):
        at = b + 4 * len(codes)
        cost[at : at + 4], last[at : at + 4] = d, _ = np.array(after), True
        for k in range(len(codes) - 1, -1, -1):
            d = (COSTS[codes[k]] + d).min(1)
            cost[b + 4 * k : b + 4 * k + 4] = d
        code[b:at] = np.repeat(np.frombuffer(codes, np.uint8), 4)
    node, state = np.arange(n), np.tile(np.arange(4), n // 4)
    made = np.array(MADE)[state]
    kept = np.array([[-1 if (to := _kept(c, q)) is None else to for q in range(4)] for c in range(16)])[code, state]
    ahead, extra, stays = node - state + 4, np.where(code & CUT > 0, TRUNCATED, 0), (code & MUST == 0) & ~last
    arcs = [  # in ASCII order
        (np.where(last, node, ahead + state), ~last, DELETE),
        (node - state + made, ~last, INSERT),
        (np.where(last | (kept < 0), node, ahead + kept), stays & (kept >= 0), KEEP + extra),
        (np.where(last, node, ahead + made), stays, REROLE + extra),
    ]
    open_ = [ok & (cost == np.minimum(cost[to] + price, FAR)) & (cost < FAR) for to, ok, price in arcs]

    def way(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Initial (0 at an end) and end of each node's arc."""
        order = np.stack([np.where(ok, (k + 1) * (n + 1) + rank[to], 5 * (n + 1)) for k, ((to, _, _), ok) in enumerate(zip(arcs, open_, strict=True))])
        first = order.argmin(0)
        none = order.min(0) == 5 * (n + 1)
        return np.where(none, 0, first + 1), np.where(none, node, np.choose(first, [to for to, _, _ in arcs]))

    rank, jump = way(np.zeros(n, np.int64))
    length, most = 1, 2 * max(len(codes) for codes, _ in pieces) + 2
    while length < most:
        rank = np.unique(rank * (n + 1) + rank[jump], return_inverse=True)[1]
        jump, length = jump[jump], 2 * length
    initial, jump = way(rank)
    jumps, length = [jump], 1
    while length < most:
        jumps.append(jumps[-1][jumps[-1]])
        length *= 2
    letters, out = np.array(["", "D", "I", "K", "R"]), []
    for b, end, own in zip(begins[:-1].tolist(), begins[1:].tolist(), states, strict=True):
        exits, audits = [0] * 4, [""] * 4
        for q in own:
            path = np.array([b + q])
            for j in jumps:
                if initial[path[-1]] == 0:
                    break
                path = np.concatenate((path, j[path]))
            audits[q] = "".join(letters[initial[path]])
            exits[q] = int(path[-1]) - (end - 4) if path[-1] >= end - 4 else q
        out.append((exits, audits))
    return out


def _emit(rows: Iterable[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows in batches of so many, or of about PIECE_CHARS characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r.get("texts", ())))
        if len(held) >= most or size >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch may hold long texts."""
    return (r for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist())


def _pieces(turns: DataFrame) -> DataFrame:
    """conv's turns in order, in pieces: a range of the whole table's order by conversation and turn, so that a conversation
    of any size is dealt over partitions. Rows of one turn go by role and text."""
    conv = turns.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, piece long, codes binary, turns array<long>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, from long, to long, n_turns long, across array<long>"
    arrow: list[pa.Schema] = []

    def close(conv: object, piece: int, rows: list[dict]) -> dict:
        codes, n = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for r in rows:
            said = r["text"].rstrip(BLANKS)
            fault = "blank" if not said else "duplicate" if not r["is_first"] else "truncated" if said[-1] not in ".!?" else ""
            if fault:
                n[fault] += 1
            codes.append((INITIALS.index(r["role"][:1]) if r["role"][:1] in tuple(INITIALS) else 3) | {"": 0, "truncated": CUT}.get(fault, MUST))
        heads, turns = [r["role"][:1] for r in rows], [r["turn"] for r in rows]
        known = [t for t in turns if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        return {"conv": conv, "piece": piece, "codes": bytes(codes), "turns": turns, "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows], **n, "illegal": illegal, "first": heads[0], "last": heads[-1], "low": min(known, default=None), "high": max(known, default=None), "from": turns[0], "to": turns[-1], "n_turns": len(set(known)), "across": _across(bytes(codes))}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        piece = TaskContext.get().partitionId() << 32
        for conv, rows in groupby(_batches(batches), key=lambda r: r["conv"]):
            got, size, first = [], 0, None
            for r in rows:
                if r["text"] is None:  # stands before the row that is the first of its role and text
                    first = r["id"]
                    continue
                got.append(r | {"is_first": r["id"] == first})
                size += len(r["text"])
                if len(got) >= PIECE_TURNS or size >= PIECE_CHARS:
                    yield close(conv, piece, got)
                    piece, got, size = piece + 1, [], 0
            if got:
                yield close(conv, piece, got)
                piece += 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(pieces(batches), arrow[0])

    arrow.append(_arrow(turns, schema))
    order = ["conv", "turn", "role", "h", "id"]
    least = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "id")).alias("least")
    firsts = turns.groupBy("conv", "role", "h").agg(least).select("conv", "least.turn", "role", "h", "least.id")
    both = turns.unionByName(firsts, allowMissingColumns=True)
    sorted_ = both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").isNotNull())
    return sorted_.mapInArrow(cut, schema)


def _arrow(like: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema.replace("from long", "`from` long").replace("to long", "`to` long")))


def _costs(pieces: DataFrame) -> DataFrame:
    """From the last piece of a conversation to the first: after, the least costs behind each piece by state (head: it is
    the first, which begins in one state only); and a row
    without piece with the conversation's numbers. A piece's row is small and of fixed size."""
    conv = pieces.schema["conv"].dataType.simpleString()
    numbers = ("blank", "duplicate", "truncated", "illegal")
    schema = f"conv {conv}, piece long, after array<long>, head boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    arrow = _arrow(pieces, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, rows in groupby(_batches(batches), key=lambda r: r["conv"]):
            after, n, later, held, lows, highs, turns = np.array(ENDING), dict.fromkeys(numbers, 0), None, None, None, None, 0
            for r in rows:
                if held:
                    yield held
                held = {"conv": conv, "piece": r["piece"], "after": after.tolist()}
                after = np.minimum((np.array(r["across"]).reshape(4, 4) + after).min(1), FAR)
                for k in numbers:
                    n[k] += r[k]
                if later:
                    n["illegal"] += r["last"] + later["first"] not in ("su", "ua", "au")
                    turns -= r["to"] is not None and r["to"] == later["from"]
                turns += r["n_turns"]
                if r["low"] is not None:
                    lows, highs = r["low"] if lows is None else min(lows, r["low"]), r["high"] if highs is None else max(highs, r["high"])
                later = r
            yield held | {"head": True}
            yield {"conv": conv, "gaps": 0 if lows is None else highs - lows + 1 - turns, **n, "cost": int(after[START])}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(each(batches), arrow, 1024)

    light = pieces.drop("codes", "turns", "roles", "texts")
    return light.repartition("conv").sortWithinPartitions("conv", F.desc("piece")).mapInArrow(fold, schema)


def _audits(pieces: DataFrame, costs: DataFrame) -> DataFrame:
    """conv, piece, state (at its beginning), audit (of the piece) of each conversation's way."""
    conv = pieces.schema["conv"].dataType.simpleString()
    ways, schema = f"conv {conv}, piece long, exits array<int>, audits array<string>", f"conv {conv}, piece long, state int, audit string"
    ways_arrow, arrow = _arrow(pieces, ways), _arrow(pieces, schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256).to_pylist()
                made = _least_paths([(r["codes"], r["after"]) for r in rows], [[START] if r["head"] else range(4) for r in rows])
                yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "piece": r["piece"], "exits": e, "audits": a} for r, (e, a) in zip(rows, made, strict=True)], ways_arrow)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, rows in groupby(_batches(batches), key=lambda r: r["conv"]):
            state, held = START, None
            for r in rows:
                if held:
                    yield held
                held = {"conv": r["conv"], "piece": r["piece"], "state": state, "audit": r["audits"][state]}
                state = r["exits"][state]
            yield held | {"audit": held["audit"] + ENDS[state]}

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(states(batches), arrow)

    met = pieces.select("conv", "piece", "codes").join(costs.filter("piece is not null").select("piece", "after", "head"), "piece")
    return met.mapInArrow(rank, ways).repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(follow, schema)


def _edited(audit: str, state: int, turns: list, roles: list[str], texts: list[str]) -> Iterator[tuple[str, int | None, str, str]]:
    """The turns that an audit leaves: edit, turn, role, text."""
    k = 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        if edit == "K":
            yield edit, turns[k], roles[k], texts[k]
            state, k = AFTER[roles[k][:1]][state], k + 1
            continue
        state = MADE[state]
        role = "user" if state == USER else "assistant"
        yield (edit, turns[k], role, texts[k]) if edit == "R" else (edit, None, role, "")
        k += edit == "R"


def _planned(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("h"), F.monotonically_increasing_id().alias("id"))
    rows = stage(rows, "turns")  # fixes the ids
    pieces = stage(_pieces(rows), "turn-pieces")
    drop_staged(rows)
    costs = stage(_costs(pieces), "repair-costs")
    return pieces, costs, _audits(pieces, costs)


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_col, piece and place (the order of a conversation's turns), edit (K kept, R given
    another role, I inserted), turn (null where inserted), role, text.

    A conversation becomes empty, or an optional system turn and then user and assistant turns in exchange, at the least
    cost; see repair_report for costs and odd rows.
    """
    pieces, _, audits = _planned(turns, conv_col, turn_col, role_col, text_col)
    schema = f"conv {pieces.schema['conv'].dataType.simpleString()}, piece long, place int, edit string, turn long, role string, text string"
    arrow = _arrow(pieces, schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _batches(batches):
            made = [{"conv": r["conv"], "piece": r["piece"], "place": k, "edit": e, "turn": t, "role": role, "text": text} for k, (e, t, role, text) in enumerate(_edited(r["audit"], r["state"], r["turns"], r["roles"], r["texts"]))]
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)

    met = pieces.select("piece", "conv", "turns", "roles", "texts").join(audits.drop("conv"), "piece")
    return met.mapInArrow(apply, schema).withColumnRenamed("conv", conv_col)


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty user or assistant turn
    2; a truncated turn that stays adds 1. Blank turns and those whose role and text came before are deleted. Of the cheapest
    repairs the one with the ASCII-least audit (initials of the edits in order) is taken.

    Rows go by turn (null first), then role and text; a null role or text is one space; repeated rows are turns of their
    own (duplicates); rows without conversation id are one conversation; an empty table gives no rows; other columns are not
    read. A conversation of any size is dealt over pieces of up to PIECE_TURNS turns; one task passes over the rows of its
    pieces in order for the digest, holding one at a time, and only its audit whole. A text must fit a row.
    """
    pieces, costs, audits = _planned(turns, conv_col, turn_col, role_col, text_col)
    conv = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    arrow, numbers = _arrow(pieces, schema), ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, rows in groupby(_batches(batches), key=lambda r: r["conv"]):
            row, audit, way, sha, first = {"conv": conv}, [], None, hashlib.sha256(), True
            for r in rows:
                if r["cost"] is not None:
                    row |= {k: r[k] for k in numbers}
                elif r["audit"] is not None:
                    way = r
                    audit.append(r["audit"])
                else:
                    for _, _, role, text in _edited(way["audit"], way["state"], r["turns"], r["roles"], r["texts"]):
                        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
            yield row | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(digests(batches), arrow)

    every = costs.filter("piece is null").drop("after", "head").unionByName(audits, allowMissingColumns=True).unionByName(pieces.select("conv", "piece", "turns", "roles", "texts"), allowMissingColumns=True)
    kind = F.when(F.col("cost").isNotNull(), 0).when(F.col("audit").isNotNull(), 1).otherwise(2)
    ordered = every.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("piece"), kind)
    return ordered.mapInArrow(digest, schema).withColumnRenamed("conv", conv_col)
