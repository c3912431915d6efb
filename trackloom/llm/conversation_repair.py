"""Conversation structure repair: the cheapest edits after which a conversation's roles read
``(system? (user assistant)+)?``.

Turns are kept or reroled (the retained subsequence) or deleted, and empty turns are inserted. The
programme goes over retained turns from the end: F(i, s) is the least cost of the turns from i on
when the last retained role is s. The next retained turn j costs the deletions between (a difference
of prefix sums), the inserts that the pair of roles needs, and its own edit, so with a running
minimum for each role over j each turn takes constant time. Of the cheapest edits the audit, one
letter for each (Delete, Insert, Keep, Rerole), that comes first in ASCII is chosen turn by turn.
An insert always stands right before a retained turn or at the end: before a deletion it would make
a later audit.

Conversations are cut by ranges of (conversation, turn), so one that holds a third of all rows is
many chunks. A conversation within one chunk is done there. For the others each chunk gives the cost
for each role before and after it, and which of its audits come first; these small rows are joined
into the roles at the chunks' borders, with which each chunk is walked. A digest over a whole text
is sequential by nature: chunks are fed to it one after another and never gathered.

Defined cases: turns go by number, null first, then by role, text and the order of repeats; a null
conversation id is a conversation of its own; a null role or text is one space, which is blank
and no role to keep; turns that are equal are duplicates of the first; a turn with both faults counts
for the first of blank, duplicate, truncated; texts of any length are read whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACES, forget, written

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
ENDS = ".!?"
#: Roles by their initials; the state of the programme is the last one retained.
NAMES = {"u": "user", "a": "assistant"}
STATES = ("", "s", "u", "a")
#: Inserts that a pair of neighbouring retained roles needs.
PAIRS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Inserts after the last retained role.
CLOSE = {"": 0, "s": 2, "u": 1, "a": 0}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60

_TURN = "conv string, conv_id {kind}, turn bigint, role string, text string, blank boolean, cut boolean, live boolean, pos bigint"
_DONE = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, live) of conversations with made faults, by the crc32 of
    ``conversation:turn``: of 20 remainders 0 drops a turn (``live`` is false then), 1 empties its
    text, 2 takes its full stops and question and exclamation marks, 3 repeats it, 4 makes it the
    user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"), (F.col("fate") != 0).alias("live"))


def costs(roles: list[str], faults: list[int], end: dict[str, int]) -> list[dict[str, int]]:
    """F for each turn and state. A fault is 0 for none, 1 for truncated, 2 for one that has to go;
    ``end`` is the cost after the last turn."""
    n = len(roles)
    least = {"s": NEVER, "u": NEVER, "a": NEVER}
    out = [end] * (n + 1)
    after = end
    for i in range(n - 1, -1, -1):
        gone = DELETE * i  # deletions before this turn
        if faults[i] < 2:
            for r in least:
                own = own_cost(roles[i], r, faults[i])
                if own is not None and (v := gone + own + after[r]) < least[r]:
                    least[r] = v
        after = {}
        for s in STATES:
            best = DELETE * n + end[s]
            for r, v in least.items():
                if (m := PAIRS.get((s, r))) is not None and v + INSERT * m < best:
                    best = v + INSERT * m
            after[s] = best - gone if best < NEVER else NEVER
        out[i] = after
    return out


def own_cost(role: str, retained: str, fault: int) -> int | None:
    """What it costs to retain a turn in a role; None where that can't be."""
    if role == retained:
        return CUT * fault
    return None if retained == "s" else REROLE + CUT * fault


def walk(roles: list[str], faults: list[int], end: dict[str, int], state: str) -> tuple[list[tuple[str, int, str]], str]:
    """The edits (letter, turn, role) of the cheapest way whose audit comes first, and the last
    state. Inserts have turn -1, deletions no role."""
    table = costs(roles, faults, end)
    out = []
    for i, role in enumerate(roles):
        now, after = table[i][state], table[i + 1]
        if DELETE + after[state] == now:
            out.append(("D", i, ""))
            continue
        ways = []
        for r in "sua":
            m, own = PAIRS.get((state, r)), own_cost(role, r, faults[i]) if faults[i] < 2 else None
            if m is not None and own is not None and INSERT * m + own + after[r] == now:
                ways.append(("I" * m + ("K" if role == r else "R"), r))
        letters, r = min(ways)
        if len(letters) > 1:
            out.append(("I", -1, "a" if r == "u" else "u"))
        out.append((letters[-1], i, r))
        state = r
    return out, state


def closing(state: str) -> list[tuple[str, int, str]]:
    return [("I", -1, r) for r in ("u", "a")[2 - CLOSE[state] :]]


def result(edits: list[tuple[str, int, str]], names: list[str], texts: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """The audit and the repaired turns."""
    turns = [(names[i] if x == "K" else NAMES[r], texts[i] if i >= 0 else "") for x, i, r in edits if x != "D"]
    return "".join(x for x, _, _ in edits), turns


class Counts:
    """Faults and gaps of a chunk's live turns in order."""

    def __init__(self, rows: list[dict], again: list[bool]) -> None:
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        self.first_turn, self.last_turn, self.turns = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)
        self.faults = [2 if r["blank"] or d else int(r["cut"]) for r, d in zip(rows, again)]
        self.blank = sum(r["blank"] for r in rows)
        self.duplicate = sum(d and not r["blank"] for r, d in zip(rows, again))
        self.truncated = sum(f == 1 for f in self.faults)
        self.roles = [r["role"][:1] for r in rows]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(self.roles, self.roles[1:]))

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()


def _whole(rows: list[dict]) -> tuple[dict, list]:
    """The results of a conversation whose turns are all here, and its repaired turns."""
    live = [r for r in rows if r["live"]]
    seen: set = set()
    again = []
    for r in live:
        again.append((r["role"], r["text"]) in seen)
        seen.add((r["role"], r["text"]))
    c = Counts(live, again)
    end = {s: INSERT * n for s, n in CLOSE.items()}
    edits, state = walk(c.roles, c.faults, end, "")
    audit, turns = result(edits + closing(state), [r["role"] for r in live], [r["text"] for r in live])
    cost = costs(c.roles, c.faults, end)[0][""]
    return {"gaps": c.gaps(), "blank": c.blank, "duplicate": c.duplicate, "truncated": c.truncated, "illegal": c.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest(turns)}, turns


def _schema(fields: str):
    """Fields as an Arrow schema, on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def _table(rows: list[dict], schema):
    import pyarrow as pa

    return pa.Table.from_pylist(rows, schema)


def _runs(batches: Iterator, columns: list[str]) -> Iterator[tuple[list[dict], bool]]:
    """Runs of one conversation's turns in consecutive places, and whether turns of other
    conversations stand right before and after, so that the run is all of it."""
    held: list[dict] = []
    begun = False  # whether the held run has another conversation right before it
    for batch in batches:
        for row in map(dict, zip(*([(c, v) for v in batch.column(i).to_pylist()] for i, c in enumerate(columns)))):
            if held and (row["pos"] != held[-1]["pos"] + 1 or row["conv"] != held[-1]["conv"]):
                follows = row["pos"] == held[-1]["pos"] + 1
                yield held, begun and follows
                held, begun = [], follows
            held.append(row)
    if held:
        yield held, False


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in order in ranges of even size, with their places."""
    bare = F.btrim(F.col("text"), F.lit(SPACES))
    given = turns.select(
        F.coalesce(F.concat(F.lit("0"), F.col("conv_id").cast("string")), F.lit("1")).alias("conv"), "conv_id", "turn", "role", "text", "copy",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"), "live", F.monotonically_increasing_id().alias("tie"),
    )
    ranged = given.repartitionByRange("conv", "turn", "role", F.xxhash64("text"), "copy", "tie").sortWithinPartitions("conv", "turn", "role", F.xxhash64("text"), "text", "copy")
    return ranged.select("conv", "conv_id", "turn", "role", "text", "blank", "cut", "live", F.monotonically_increasing_id().alias("pos"))


def repair(turns: DataFrame, keep_turns: bool = False) -> DataFrame:
    """For each conversation of ``turns(conv_id, turn, role, text, copy, live)``, as :func:`damaged` or
    :func:`as_given` make them: its faults and gaps, the least cost, the audit and the digest of the
    repaired turns; with ``keep_turns`` the turns themselves instead, see :func:`repaired`."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = _TURN.format(kind=kind)
    columns = [f.split()[0] for f in fields.split(", ")]
    numbers = [f.split()[0] for f in _DONE.split(", ")]
    both = f"chunk bigint, done struct<{_DONE}>, turns array<struct<role: string, text: string>>, {fields}"

    schema = _schema(both)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, size = [], 0
        for rows, whole in _runs(batches, columns):
            chunk = rows[0]["pos"]
            if whole:
                done, made = _whole(rows)
                new = [{"chunk": chunk, "conv_id": rows[0]["conv_id"], "done": done, "turns": [{"role": r, "text": t} for r, t in made] if keep_turns else None}]
            else:
                new = [{"chunk": chunk, **r} for r in rows]
            out += new
            size += sum(len(r["text"]) + 100 for r in rows)
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    ordered = written(_ordered(turns), "turns")
    folded = written(ordered.mapInArrow(fold, both), "folded")
    forget(ordered)
    closed = folded.where("done is not null")
    pieces = _pieces(folded.where("done is null"), kind)
    if keep_turns:
        each = closed.select("conv_id", "chunk", "turns").union(pieces.select("conv_id", "chunk", "turns"))
        return each.select("conv_id", "chunk", F.posexplode("turns").alias("at", "t")).select("conv_id", "chunk", "at", "t.role", "t.text")
    return closed.select("conv_id", "done.*").union(_joined(pieces, kind, numbers))


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, at, role, text): the repaired turns; those of a conversation are in order by
    (chunk, at)."""
    return repair(turns, keep_turns=True)


def as_given(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without made faults, for :func:`repair`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.lit(0).alias("copy"), F.lit(True).alias("live"))


_SUMMARY = "conv string, chunk bigint, n bigint, turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, costs array<bigint>, ranks array<int>"


def _chunk(table) -> tuple[list[dict], Counts]:
    rows = sorted((r for r in table.to_pylist() if r["live"]), key=lambda r: r["pos"])
    return rows, Counts(rows, [r["first"] is not None and r["first"] < r["pos"] for r in rows])


def _only(state: str) -> dict[str, int]:
    return {s: 0 if s == state else NEVER for s in STATES}


def _summary(table) -> dict:
    """A chunk in one row: costs and order of audits for each role before (rows) and after (columns)."""
    rows, c = _chunk(table)
    cost, ranks = [], []
    tables = {s: costs(c.roles, c.faults, _only(s))[0] for s in STATES}
    for a in STATES:
        audits = {b: "".join(x for x, _, _ in walk(c.roles, c.faults, _only(b), a)[0]) for b in STATES if tables[b][a] < NEVER}
        order = sorted(audits, key=audits.get)
        cost += [tables[b][a] for b in STATES]
        ranks += [order.index(b) if b in audits else len(STATES) for b in STATES]
    head = table.slice(0, 1).to_pylist()[0]
    one = {"conv": head["conv"], "chunk": head["chunk"], "n": len(rows), "turns": c.turns, "first_turn": c.first_turn, "last_turn": c.last_turn, "blank": c.blank, "duplicate": c.duplicate, "truncated": c.truncated, "illegal": c.illegal}
    edges = {"first_role": c.roles[0] if rows else None, "last_role": c.roles[-1] if rows else None}
    return {**one, **edges, "costs": cost, "ranks": ranks}


_BORDERS = "conv string, chunk bigint, before string, after string, last boolean, cost bigint, gaps bigint, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint"


def _borders(table) -> list[dict]:
    """Roles before and after each chunk of a conversation from its chunks' summaries, and the
    conversation's counts."""
    chunks = sorted(table.to_pylist(), key=lambda c: c["chunk"])
    value = [{s: INSERT * n for s, n in CLOSE.items()}]
    for c in reversed(chunks):
        value.append({s: min(c["costs"][4 * i + k] + value[-1][t] for k, t in enumerate(STATES)) for i, s in enumerate(STATES)})
    value.reverse()
    turns = [c for c in chunks if c["turns"]]
    same = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns, turns[1:]))
    live = [c for c in chunks if c["n"]]
    total = {f"n_{k}": sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["n_illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(live, live[1:]))
    total["gaps"] = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - sum(c["turns"] for c in turns) + same if turns else 0
    out, state = [], ""
    for c, now, then in zip(chunks, value, value[1:]):
        i = 4 * STATES.index(state)
        ways = [(c["ranks"][i + k], t) for k, t in enumerate(STATES) if c["costs"][i + k] < NEVER and c["costs"][i + k] + then[t] == now[state]]
        out.append({"conv": c["conv"], "chunk": c["chunk"], "before": state, "after": (state := min(ways)[1]), "last": c is chunks[-1], "cost": value[0][""], **total})
    return out


def _pieces(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that cross a border of chunks: each chunk's audit and repaired turns."""
    open_ = rows.drop("done", "turns").withColumn("hash", F.md5("text"))
    first = open_.where("live and not blank").groupBy("conv", "role", "hash").agg(F.min("pos").alias("first"))
    marked = written(open_.join(first, ["conv", "role", "hash"], "left").drop("hash"), "open-turns")
    rows_of = lambda make, schema: lambda table: _table(make(table), schema)
    summary = marked.drop("text", "conv_id").groupBy("conv", "chunk").applyInArrow(rows_of(lambda t: [_summary(t)], _schema(_SUMMARY)), _SUMMARY)
    borders = written(summary.groupBy("conv").applyInArrow(rows_of(_borders, _schema(_BORDERS)), _BORDERS), "borders")
    fields = f"conv_id {kind}, audit string, turns array<struct<role: string, text: string>>, {_BORDERS}"

    schema = _schema(fields)

    def walked(left, right):
        rows, c = _chunk(left)
        b = right.to_pylist()[0]
        edits, _ = walk(c.roles, c.faults, _only(b["after"]), b["before"])
        audit, turns = result(edits + (closing(b["after"]) if b["last"] else []), [r["role"] for r in rows], [r["text"] for r in rows])
        one = {"conv_id": left.column("conv_id")[0].as_py(), "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns], **b}
        return _table([one], schema)

    return marked.groupBy("conv", "chunk").cogroup(borders.groupBy("conv", "chunk")).applyInArrow(walked, fields)


def _joined(pieces: DataFrame, kind: str, numbers: list[str]) -> DataFrame:
    """One row for each conversation of ``pieces``, whose chunks are fed to its digest in order."""
    fields = f"conv_id {kind}, {_DONE}"
    columns, schema = pieces.columns, _schema(fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        audit, sha, any_ = [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(columns)}
                audit.append(r["audit"])
                for t in r["turns"]:
                    sha.update(("\n" * any_ + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                    any_ = True
                if r["last"]:
                    counts = {k: r[f"n_{k}"] for k in ("blank", "duplicate", "truncated", "illegal")}
                    out.append({"conv_id": r["conv_id"], "gaps": r["gaps"], **counts, "cost": r["cost"], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    audit, sha, any_ = [], hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(out, schema)

    return pieces.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(run, fields).select("conv_id", *numbers)
