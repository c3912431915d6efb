"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

Both supported kinds of tokenizer give the ids of a text as those of its pieces between
single spaces, one after another, unless a special token's string may occur or, where spaces
are kept, a space is followed by white space or the end; such texts are encoded whole. Where
words are cut by _CUT and their ends are marked, the tokenizer is asked for each run of
letters once, however it is written and whatever signs stand beside it; only what can't be cut
safely (_PLAIN) is encoded piece by piece. Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Where spaces may be kept, a text with one of these is encoded whole.
_WHOLE = re.compile(r" (?:\s|\Z)|<\|")
#: Pieces that are cut into runs of letters and others. Up to U+00FF nothing is composed, and each
#: letter has one letter in lower case; an apostrophe may take letters to itself.
_PLAIN = re.compile(r"[^'\u0100-\U0010ffff]*")
_RUNS = re.compile(r"[a-zªµºß-öø-ÿ]+| |[^ a-zªµºß-öø-ÿ]+")
#: Normalisation and words of the vocabularies for which that holds.
_STEPS = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A character of private use that stands alone between pieces.
RULE = "\ue000"
CACHE_PIECES = 500_000
CHUNK_CHARS = 1_000_000
#: New pieces that are encoded as one text: a long text costs more for each of its pieces.
JOINED = 100


def _last(about: dict):
    """Which ids end a word, for vocabularies whose words are cut by _CUT, whose case and kind of white
    space make no difference, and in which each word's last token tells that it is; else None."""
    import numpy as np
    from tokenizers.pre_tokenizers import ByteLevel

    vocab, suffix = about["model"]["vocab"], about["model"].get("end_of_word_suffix")
    steps = [(n["type"], n.get("pattern")) for n in about["normalizer"].get("normalizers", ())]
    cuts = [c.get("pattern") for c in (about["pre_tokenizer"] or {}).get("pretokenizers", ())]
    if not suffix or steps != _STEPS or cuts != [{"Regex": _CUT}, None] or not all({c, c + suffix} <= vocab.keys() for c in ByteLevel.alphabet()):
        return None
    found = np.zeros(max(vocab.values()) + 1, bool)
    found[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return found


class Encoder:
    """Byte-level vocabularies keep the space before a piece, others drop it."""

    def __init__(self, path: str, end_id: int | None = None, cache: int = CACHE_PIECES):
        import json
        import os
        import struct

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.lead = "" if about.get("normalizer") else " "
        self.last = None if self.lead else _last(about)
        if self.lead:  # each character of a token stands for a byte
            sizes = {i: len(t) for t, i in about["model"]["vocab"].items()}
            self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])
        else:
            self.rule = self.tokenizer.encode(RULE, add_special_tokens=False).ids
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.known: dict[str, bytes] = {}
        self.runs = {" ": b""}
        self.cache = cache

    def _one(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, encoded together, which spares the cost of a call for each. Where
        a piece ends is told by the bytes that tokens stand for, or, where the tokenizer changes
        its text, by the ids of a rule that is put between pieces."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            if not self.lead and any(RULE in p for p in part):
                out += map(self._one, part)
                continue
            joined = [" " + " ".join(part[i : i + JOINED]) for i in range(0, len(part), JOINED)] if self.lead else [f" {RULE} ".join(part)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            if self.lead:
                done = np.cumsum(self.sizes[ids])
                ends = np.searchsorted(done, np.cumsum([1 + len(p.encode("utf-8", "surrogatepass")) for p in part])) + 1
                begins = np.concatenate(([0], ends[:-1]))
            else:
                n = len(self.rule)
                met = np.ones(max(0, len(ids) - n + 1), bool)
                for k, x in enumerate(self.rule):
                    met &= ids[k : len(ids) - n + 1 + k] == x
                rules = np.flatnonzero(met)
                ends, begins = np.append(rules, len(ids)), np.concatenate(([0], rules + n))
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((begins * 4).tolist(), (ends * 4).tolist())]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded together; each ends with its first token that ends a word."""
        import numpy as np

        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False))])
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _by_runs(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, put together from those of its runs; pieces that can't be cut count as one."""
        import numpy as np

        text, odd = " ".join(pieces), {}
        if not _PLAIN.fullmatch(text):
            odd = dict.fromkeys(p for p in pieces if not _PLAIN.fullmatch(p))
            text = " ".join(["" if p in odd else p for p in pieces])
        runs = _RUNS.findall(text.lower())
        ids = list(map(self.runs.get, runs))
        holes = [i for i, x in enumerate(ids) if x is None]
        fresh = dict.fromkeys([runs[i] for i in holes])
        words = [r for r in fresh if r.isalpha()]
        others = [*(r for r in fresh if not r.isalpha()), *odd]
        new = dict(zip(words, self._words(words), strict=True))
        new.update(zip(others, self._many(others), strict=True))
        for i in holes:
            ids[i] = new[runs[i]]
        if len(self.runs) + len(new) <= self.cache:
            self.runs.update(new)
        done = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        ends = done[np.array([i for i, r in enumerate(runs) if r == " "], int)].tolist()
        raw = b"".join(ids)
        found = [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)])]
        return [new.get(p, x) for p, x in zip(pieces, found)] if odd else found

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        look = self.known.get
        found: list[tuple | None] = []
        new: dict[str, bytes] = {}
        for t in texts:
            # with a lead, pieces that make a text whole are never known, so they are among the holes
            if "<|" in t if self.lead or self.last is not None else _WHOLE.search(t):
                found.append(None)
                continue
            pieces = t.split(" ")
            head = pieces.pop(0) if self.lead else None
            ids = list(map(look, pieces))
            holes = [i for i, x in enumerate(ids) if x is None]
            fresh = [pieces[i] for i in holes]
            if self.lead and fresh and _WHOLE.search(" " + " ".join(fresh)):
                found.append(None)
                continue
            new.update(dict.fromkeys(fresh, b""))
            found.append((head, ids, zip(holes, fresh)))
        fresh = list(new)
        new = dict(zip(fresh, self._many(fresh) if self.last is None else self._by_runs(fresh)))
        for t, own in zip(texts, found):
            if own is None:
                yield self._one(t) + self.end
                continue
            head, ids, holes = own
            for i, p in holes:
                ids[i] = new[p]
            yield b"".join([b"" if head is None else self._one(head), *ids, self.end])
        if len(self.known) + len(new) <= self.cache:
            self.known.update(new)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, with the end id; a null text counts as empty."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= CHUNK_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder for each vocabulary and Python worker, so that later tasks find its cache."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
