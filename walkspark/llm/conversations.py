"""Repair of conversations by weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows; an edit transducer that keeps, re-roles or deletes a
row and inserts rows; and the acceptor of the role grammar (s?(ua)+)?. The composition is never built: its states are
pairs of a row and a grammar state, and they are expanded row by row, from the last to the first. Weights are pairs of
cost and label string, compared in that order; adding along a path adds costs and joins strings. Read from the end, a
state's best weight needs of the strings behind it only their order, so a step is a small table of the four grammar
states, and equal steps are made once.

Rows are put in order by a range sort, so a conversation of any length is spread over tasks. Each task composes the
stretches of rows it holds into a 4 x 4 table of weights; stretches of one conversation are then composed with each
other. Only a stretch, of bounded size, is ever held at once. The digest of a repaired text is one chain by its definition:
of conversations that several stretches hold, the kept lines pass one task in order, stretch by stretch, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import stored

BLANKS = " \t\n\x0b\f\r"
#: Grammar states: at the start, after a system row, after a user row, after an assistant row; the last and the first accept.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = ("user", "user", "assistant", "user")
INF = 1 << 60
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: A stretch has at most so many rows and about so many characters.
ROWS, CHARACTERS = 4096, 1 << 22


def _after(state: int) -> int:
    """The grammar state after the role that a state expects."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The grammar state after a kept row of this role initial, if the grammar takes it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _after(state) if initial == EXPECTED[state][0] else None


def _closed(best: list[tuple[int, str, int]]) -> tuple:
    """best with insertions before the row: of each state (cost, labels of this step, state behind them)."""
    cost = lambda c: (c[0] + INSERT, "I" + c[1], c[2])
    user, assistant = best[USER], best[ASSISTANT]
    to_user, to_assistant = min(user, cost(assistant)), min(assistant, cost(user))
    return min(best[START], cost(to_user)), min(best[SYSTEM], cost(to_user)), to_user, to_assistant


@lru_cache(maxsize=1 << 16)
def step(initial: str, fault: str, costs: tuple, order: tuple) -> tuple:
    """One row, read from the end. costs, order: of each grammar state the least cost behind this row, and the place of its label string among the four.

    Gives (choices, costs, order, base): choices[q] = (labels, state behind the row); costs are above base, INF where there is no way."""
    base = min(costs)
    found = []
    for q in range(4):
        ways = [(DELETE + costs[q], "D", order[q], q)]
        if fault not in ("blank", "duplicate"):
            more, r, k = CUT if fault == "truncated" else 0, _after(q), _kept(q, initial)
            ways.append((REROLE + more + costs[r], "R", order[r], r))
            if k is not None:
                ways.append((more + costs[k], "K", order[k], k))
        found.append(min(ways))
    # two ways with one cost and labels are told apart by the order of the strings behind them
    closed = _closed([(c, label, (o, r)) for c, label, o, r in found])
    ranks = {x: i for i, x in enumerate(sorted({c[1:] for c in closed}))}
    level = min(c[0] for c in closed)
    out = tuple(min(c[0] - level, INF) if c[0] < INF else INF for c in closed)
    return tuple((c[1], c[2][1]) for c in closed), out, tuple(ranks[c[1:]] for c in closed), level - base if level < INF else 0


def _end(states: dict[int, int]) -> tuple:
    return tuple(states.get(q, INF) for q in range(4)), (0, 0, 0, 0)


def compose(rows: list[tuple[str, str]], end: tuple, last: tuple | None = None) -> list[tuple[int, str] | None]:
    """Of each grammar state the least (cost, labels) of a way through rows (role initial, fault) to the weights in end.

    last: labels of insertions behind the last row, for each state."""
    costs, order = end
    total, path = min(costs), []
    for initial, fault in reversed(rows):
        choices, costs, order, rise = step(initial, fault, tuple(c - min(costs) if c < INF else INF for c in costs), order)
        total += rise
        path.append(choices)
    out = []
    low = min(costs)
    for q in range(4):
        if costs[q] >= INF:
            out.append(None)
            continue
        labels, state = [], q
        for choices in reversed(path):
            said, state = choices[state]
            labels.append(said)
        out.append((total + costs[q] - low, "".join(labels) + (last[state] if last else "")))
    return out


#: Behind the last row only insertions are left: of each state their cost and labels.
FINAL = ((0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0))
FINAL_LABELS = ("", "II", "I", "")


def whole(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, labels) of the cheapest repair of a conversation; of equally cheap ones the least string."""
    return compose(rows, FINAL, FINAL_LABELS)[START]


def through(rows: list[tuple[str, str]]) -> list[list[tuple[int, str] | None]]:
    """The 4 x 4 table of a stretch of rows: [from][to] = (cost, labels). Insertions stand before rows only."""
    to = [compose(rows, _end({r: 0})) for r in range(4)]
    return [[to[r][q] for r in range(4)] for q in range(4)]


def joined(tables: list[list[list]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Stretches in order composed: (cost, labels, [(state at its start, labels) of each stretch])."""
    best = [(c, x, ()) for c, x in zip(FINAL[0], FINAL_LABELS)]
    for table in reversed(tables):
        best = [min(((w[0] + b[0], w[1] + b[1], ((q, w[1]), *b[2])) for w, b in zip(table[q], best) if w and b), default=None) for q in range(4)]
    cost, labels, ways = best[START]
    return cost, labels, list(ways)


def lines(state: int, labels: str, rows: list[tuple[str, str]]) -> list[str]:
    """The repaired `role:text` lines of rows (role, text), from a grammar state on."""
    out, at = [], iter(rows)
    for x in labels:
        role, text = ("", "") if x == "I" else next(at)
        if x == "D":
            continue
        role = role if x == "K" else EXPECTED[state]
        state = _kept(state, role[:1])
        out.append(f"{role}:{text}")
    return out


def damaged(df: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(id, turn, role, text, n): rows as crc32 of `id:turn` damages them, n times each; dropped ones have n = 0."""
    how = F.crc32(F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))) % 20
    rows = df.select(F.col(id).cast("string").alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), how.alias("how"))
    said = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows (key, id, turn, role, text, n, h, fault) with copies counted together: fault is blank, duplicate, truncated or ''; of the first copy.

    key: the id as a string that null has too; h: a digest of role and text."""
    key = F.concat(F.when(F.col("id").isNull(), ",").otherwise(";"), F.coalesce("id", F.lit("")))
    h = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.groupBy("id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumns({"key": key, "h": h, "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    rows = stored(rows, "talk-rows")
    again = rows.filter("n > 0").groupBy("key", "h").agg(F.min("at").alias("first"), F.count("*").alias("turns")).filter("turns > 1").select("key", "h", "first")
    said = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(said == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.join(again, ["key", "h"], "left").select("key", "id", "turn", "role", "text", "n", "h", F.coalesce(fault, F.lit("")).alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "n")
_INTS = ("lo", "hi", "turns", *COUNTS, "cost")
_PART = pa.schema([("key", pa.string()), ("id", pa.string()), ("part", pa.int32()), ("stretch", pa.int32()), ("open", pa.bool_()), *[(c, pa.int64()) for c in _INTS], ("first", pa.string()), ("last", pa.string()), ("audit", pa.string()), ("digest", pa.string()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
PART = "key string, id string, part int, stretch int, open boolean, " + ", ".join(f"{c} long" for c in _INTS) + ", first string, last string, audit string, digest string, costs array<long>, labels array<string>, roles array<string>, texts array<string>"


class _Stretch:
    """Rows of one conversation that follow each other."""

    def __init__(self, key: str, id: str | None, number: int):
        self.key, self.id, self.number, self.rows, self.said, self.characters, self.turns = key, id, number, [], [], 0, []

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn not in self.turns[-1:]:
            self.turns.append(turn)
        self.rows.append((role[:1], fault))
        self.said.append((role, text))
        self.characters += len(role) + len(text)

    def record(self, part: int, open: bool) -> dict:
        """What the stretch says if it is its whole conversation; an open one also as a part of a longer one."""
        cost, audit = whole(self.rows)
        initials, faults = [x for x, _ in self.rows], [x for _, x in self.rows]
        digest = hashlib.sha256("\n".join(lines(START, audit, self.said)).encode()).hexdigest()
        out = {"key": self.key, "id": self.id, "part": part, "stretch": self.number, "open": open, "lo": self.turns[0] if self.turns else None, "hi": self.turns[-1] if self.turns else None, "turns": len(self.turns)}
        out |= {c: faults.count(c) for c in ("blank", "duplicate", "truncated")} | {"illegal": sum(map(_illegal, initials, initials[1:])), "n": len(initials), "cost": cost, "audit": audit, "digest": digest}
        if open:
            table = [w for row in through(self.rows) for w in row]
            out |= {"first": initials[0] if initials else None, "last": initials[-1] if initials else None, "costs": [w and w[0] for w in table], "labels": [w and w[1] for w in table], "roles": [r for r, _ in self.said], "texts": [t for _, t in self.said]}
        return out


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield from zip(*[batch.column(c).slice(lo, size).to_pylist() for c in columns])


def _stretches(most: int, characters: int):
    """A record for each stretch of a task's sorted rows. The first and last of a task, and those that were cut, are open: their conversation may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size, cut = TaskContext.get().partitionId(), [], None, 0, True

        for key, id, turn, role, text, n, fault in _rows(batches, ("key", "id", "turn", "role", "text", "n", "fault")):
            if held is None or held.key != key:
                if held is not None:
                    made.append(held.record(part, cut))
                    size, cut = size + held.characters, False
                held = _Stretch(key, id, held.number + 1 if held else 0)
            for copy in range(n):
                if len(held.rows) >= most or held.characters >= characters:
                    made.append(held.record(part, True))
                    size, cut = size + held.characters, True
                    held = _Stretch(key, id, held.number + 1)
                held.add(turn, role, text, "duplicate" if copy and fault != "blank" else fault)
                if len(made) >= 1000 or size >= characters:
                    yield pa.RecordBatch.from_pylist(made, schema=_PART)
                    made, size = [], 0
        if held is not None:
            made.append(held.record(part, True))
        yield pa.RecordBatch.from_pylist(made, schema=_PART)

    return run


_WAY = pa.struct([("part", pa.int32()), ("stretch", pa.int32()), ("state", pa.int32()), ("said", pa.string())])
_WHOLE = pa.schema([("key", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.list_(_WAY)), ("tail", pa.string())])
WHOLE = "key string, lo long, hi long, turns long, illegal long, cost long, audit string, ways array<struct<part int, stretch int, state int, said string>>, tail string"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (key, parts in order) with what lies between their stretches counted and their tables composed."""
    for key, parts in _rows(batches, ("key", "parts"), 1):
        tables = [[[None if c is None else (c, x) for c, x in zip(p["costs"][4 * q : 4 * q + 4], p["labels"][4 * q : 4 * q + 4])] for q in range(4)] for p in parts]
        cost, audit, ways = joined(tables)
        timed, filled = [p for p in parts if p["lo"] is not None], [p for p in parts if p["n"]]
        turns = sum(p["turns"] for p in parts) - sum(a["hi"] == b["lo"] for a, b in zip(timed, timed[1:]))
        illegal = sum(p["illegal"] for p in parts) + sum(_illegal(a["last"], b["first"]) for a, b in zip(filled, filled[1:]))
        made = {"key": key, "lo": timed[0]["lo"] if timed else None, "hi": timed[-1]["hi"] if timed else None, "turns": turns, "illegal": illegal, "cost": cost, "audit": audit, "ways": [{"part": p["part"], "stretch": p["stretch"], "state": q, "said": x} for p, (q, x) in zip(parts, ways)], "tail": audit[sum(len(x) for _, x in ways) :]}
        yield pa.RecordBatch.from_pylist([made], schema=_WHOLE)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of conversations whose stretches come in order: one running hash, fed stretch by stretch."""
    schema = pa.schema([("key", pa.string()), ("digest", pa.string())])
    last, h, begun, tail = None, None, False, ""

    def feed(some: list[str]) -> None:
        nonlocal begun
        for x in some:
            h.update((("\n" if begun else "") + x).encode())
            begun = True

    def closed() -> pa.RecordBatch:
        feed(lines(USER if len(tail) == 1 else SYSTEM, tail, []))
        return pa.RecordBatch.from_pylist([{"key": last, "digest": h.hexdigest()}], schema=schema)

    for key, state, said, roles, texts, end in _rows(batches, ("key", "state", "said", "roles", "texts", "tail"), 1):
        if h is None or key != last:
            if h is not None:
                yield closed()
            last, h, begun = key, hashlib.sha256(), False
        feed(lines(state, said, list(zip(roles, texts))))
        tail = end
    if h is not None:
        yield closed()


def repair(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS, characters: int = CHARACTERS) -> DataFrame:
    """Damage rows and repair their conversations: for each id a row of gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn (null ones first; of one turn by a digest of role and text, copies side by side). A null role or text is one
    space, a null id is a conversation of its own. Blank and empty texts are faults; texts of any length are read whole. An id
    whose rows are all dropped has zeros, no edits and the digest of nothing. Repeated rows are duplicates. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    rows = judged(damaged(df, id, turn, role, text))
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(dealt.select("key", "id", "turn", "role", "text", "n", "fault").mapInArrow(_stretches(most, characters), PART), "talk-stretches")
    several = parts.filter("open").groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    facts = ["key", "id", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    single = parts.filter("not open").select(*facts).unionByName(parts.filter("open").join(several, "key", "left_anti").select(*facts))
    # conversations of several stretches: their texts stay where they are until the edits are known
    open_parts = parts.filter("open").join(several, "key", "left_semi")
    each = F.struct("part", "stretch", "lo", "hi", "turns", "illegal", "n", "first", "last", "costs", "labels")
    sums = open_parts.groupBy("key").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.array_sort(F.collect_list(each)).alias("parts"))
    composed = stored(sums.select("key", "parts").mapInArrow(_composed, WHOLE), "talk-composed")
    said = composed.select("key", "tail", F.explode("ways").alias("w")).select("key", "tail", "w.*")
    chain = open_parts.select("key", "part", "stretch", "roles", "texts").join(said, ["key", "part", "stretch"])
    chain = chain.repartition("key").sortWithinPartitions("key", "part", "stretch").select("key", "state", "said", "roles", "texts", "tail")
    spread = sums.drop("parts").join(composed.drop("ways", "tail"), "key").join(chain.mapInArrow(_chained, "key string, digest string"), "key").select(*facts)
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    return single.unionByName(spread).select(F.col("id").cast(df.schema[id].dataType).alias(id), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
