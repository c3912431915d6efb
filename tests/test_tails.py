"""Sources that follow growing logs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trackloom.sources import tails
from trackloom.streaming import processors as st


def drain(df, checkpoint, column, got):
    q = st.start(df, lambda d, b: got.extend(r[column] for r in d.collect()), checkpoint, None)
    q.awaitTermination(120)
    assert q.exception() is None
    return got


def add(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_lines_from_the_present_end(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    add(folder / "obs_a.jsonl", "old 1\nold 2\npart")
    add(folder / "other.txt", "never\n")
    tail = lambda: tails.follow(spark, tails.LineTail, str(folder), pattern="obs_*.jsonl")
    read = lambda: drain(tail(), str(tmp_path / "cp"), "line", [])
    assert read() == []
    add(folder / "obs_a.jsonl", "ly new\nnew 1\n\nhalf")
    add(folder / "obs_b.jsonl", "b 1\n")
    assert sorted(read()) == ["b 1", "new 1", "partly new"]  # each query goes on from the checkpoint
    assert read() == []
    add(folder / "obs_a.jsonl", " done\n")
    assert read() == ["half done"]
    (folder / "obs_a.jsonl").write_text("cut 1\n")  # shorter than what was read
    assert read() == ["cut 1"]
    os.remove(folder / "obs_b.jsonl")
    add(folder / "b2", "replaced 1 longer than before\nreplaced 2\n")
    os.replace(folder / "b2", folder / "obs_b.jsonl")
    assert sorted(read()) == ["replaced 1 longer than before", "replaced 2"]


def test_a_file_that_begins_otherwise_is_another(tmp_path):
    """Even where the new file has the old one's inode."""
    add(tmp_path / "a.jsonl", "one\ntwo\n")
    reader = tails.LineReader({"path": str(tmp_path), "start": "begin"})
    before = reader.latestOffset()
    add(tmp_path / "a.jsonl", "three\n")
    read = lambda: [r[2] for p in reader.partitions(before, reader.latestOffset()) for r in reader.read(p)]
    assert read() == ["three"]
    with open(tmp_path / "a.jsonl", "r+") as f:
        f.write("ONE\ntwo\nthree\nfour\n")
    assert read() == ["ONE", "two", "three", "four"]


def test_lines_in_slices_are_read_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [f"{i} " + "é" * (i % 40) for i in range(300)] + ["x" * 5000, "last"]
    add(folder / "a.jsonl", "\n".join(lines) + "\n")
    for most in (1, 7, 64, 1 << 20):
        reader = tails.LineReader({"path": f"file://{folder}", "start": "begin", "maxBytesPerPartition": str(most)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [r[2] for p in parts for r in reader.read(p)] == lines
    with pytest.raises(ValueError):
        tails.LineReader({"path": str(folder), "start": "middle"})


def test_last_whole_line_of_long_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tails, "BACK", 4)
    path = str(tmp_path / "f")
    for text in ("", "a", "ab\ncdefghijk", "abcdefgh\n", "\n\n", "a\nb\nccccccccccccc"):
        (tmp_path / "f").write_text(text)
        assert tails.whole_lines(path, len(text)) == text.rfind("\n") + 1


def test_entries_after_the_last_id(spark, tmp_path):
    folder = str(tmp_path / "log")
    tails.append_entries(folder, [("9-0", "{}"), ("10-0", "old")])
    new = lambda: tails.follow(spark, tails.EntryLog, folder)
    cp = str(tmp_path / "cp")
    assert drain(new(), cp, "payload", []) == []
    tails.append_entries(folder, [("10-1", "a"), ("100-0", "b")])
    tails.append_entries(folder, [("100-2", None), ("1000-0", json.dumps({"n": 1}))])
    tails.append_entries(folder, [])
    assert sorted(drain(new(), cp, "payload", [])) == ["a", "b", '{"n": 1}', "{}"]
    assert drain(new(), cp, "id", []) == []
    every = drain(tails.follow(spark, tails.EntryLog, folder, start="0"), str(tmp_path / "cp2"), "id", [])
    assert sorted(every, key=tails.entry_key) == ["9-0", "10-0", "10-1", "100-0", "100-2", "1000-0"]
    some = drain(tails.follow(spark, tails.EntryLog, folder, start="10-1"), str(tmp_path / "cp3"), "id", [])
    assert sorted(some) == ["100-0", "100-2", "1000-0"]
    assert tails.EntryReader({"path": folder}).partitions({"id": "10-1"}, {"id": "100-0"}) == [tails.Segment(tails._segment("10-1"), "10-1", "100-0")]


def test_an_empty_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert drain(tails.follow(spark, tails.EntryLog, str(tmp_path / "log")), str(tmp_path / "cp"), "id", []) == []
    stream = tails.follow(spark, tails.LineTail, str(tmp_path / "log")).select(F.get_json_object("line", "$.a").alias("a"))
    assert drain(stream, str(tmp_path / "cp2"), "a", []) == []
