"""Conversation repair against every way of editing, and over chunks of any size."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from trackloom.llm import conversation_repair as cr
from trackloom.llm import queries

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, turns) by trying every edit of every row; rows are (role, text, fault)."""

    @cache
    def best(i, made, room=2):  # made: the last initial; room: inserts that may still come before row i
        ways = [(0, "", ())] if i == len(rows) and made in ("", "a") else []
        if i < len(rows):
            role, text, fault = rows[i]
            edits = [("D", 3, None)]
            if fault in ("", "truncated"):
                more = fault == "truncated"
                edits += [("K", more, role), ("R", 2 + more, "user"), ("R", 2 + more, "assistant")]
            for letter, cost, name in edits:
                if name is None or legal(made, name[:1]):
                    c, a, t = best(i + 1, made if name is None else name[:1])
                    ways.append((c + cost, letter + a, t if name is None else ((name, text), *t)))
        for name in ("user", "assistant"):
            if room and legal(made, name[0]):
                c, a, t = best(i, name[0], room - 1)
                ways.append((c + 2, "I" + a, ((name, ""), *t)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return best(0, "")


def legal(made, r):
    return r != "" and made + r in {"s", "u", "su", "ua", "au"}


def everything(rows):
    """The same for very short conversations without any thought: all strings of edits."""
    found = []
    inserts = ["", "u", "a", "ua", "au"]

    def go(i, cost, audit, made):
        for extra in inserts:
            c, a, m = cost + 2 * len(extra), audit + "I" * len(extra), made + extra
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", m):
                    found.append((c, a))
                continue
            role, _, fault = rows[i]
            go(i + 1, c + 3, a + "D", m)
            if fault in ("", "truncated"):
                more = fault == "truncated"
                go(i + 1, c + more, a + "K", m + (role[:1] or "?"))
                go(i + 1, c + 2 + more, a + "R", m + "u")
                go(i + 1, c + 2 + more, a + "R", m + "a")

    go(0, 0, "", "")
    return min(found)


def plain(turns):
    """Results by conversation of (conv_id, turn, role, text) rows, all in Python."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
        marked, seen = [], set()
        for _, role, text in rows:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit, kept = cheapest(tuple(marked))
        count = lambda k: sum(m[2] == k for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def results(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_every_way_of_editing():
    rng = random.Random(3)
    for _ in range(150):
        rows = tuple((rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "x", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 3)))
        assert everything(rows) == cheapest(rows)[:2]
        roles, faults = [r[0][:1] for r in rows], [{"": 0, "truncated": 1, "blank": 2}[r[2]] for r in rows]
        end = {s: 2 * n for s, n in cr.CLOSE.items()}
        edits, state = cr.walk(roles, faults, end, "")
        assert (cr.costs(roles, faults, end)[0][""], "".join(e[0] for e in edits + cr.closing(state))) == everything(rows)


def made(rng, n, length):
    said = ["Yes.", "No", "Why?", "", " \t", "So it is!", "one two", None]
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(length)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(said) if rng.random() < 0.5 else f"text {i}{rng.choice(['', '.'])}") for i in range(n * length)]


@pytest.mark.parametrize("parts", [1, 40])
def test_query_equals_plain(spark, tmp_path, parts):
    rng = random.Random(parts)
    turns = made(rng, 25, 9)
    turns = list({(t[0], t[1]): t for t in turns}.values())  # one row a turn: their order is clear
    turns += [(77, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"t {i}."])) for i in range(400)]  # over many chunks
    turns += [(78, t, "user", "dropped") for t in range(300) if zlib.crc32(f"78:{t}".encode()) % 20 == 0]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = results(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(turns)
    assert got[78] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_over_the_shared_table(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.QUERIES["op12_conversation_repair"](spark, SF)) == plain(turns)


def test_repeats_long_texts_and_other_columns(spark):
    long = "word " * 300_000 + "end."
    turns = [("a", 1, "user", long, "x"), ("a", 1, "user", long, "y"), ("a", 2, "assistant", "Yes.", "z"), (None, None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string, conv string")
    got = results(cr.repair(cr.as_given(df)))
    assert got["a"][:7] == (0, 0, 1, 0, 1, 3, "KDK") and got[None][:7] == (0, 1, 0, 0, 0, 3, "D")
    assert got["a"][7] == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()
    rows = sorted(cr.repaired(cr.as_given(df)).collect(), key=lambda r: (r["chunk"], r["at"]))
    assert [(r["conv_id"], r["role"], r["text"]) for r in rows] == [("a", "user", long), ("a", "assistant", "Yes.")]
    assert cr.repair(cr.as_given(df.limit(0))).count() == 0
