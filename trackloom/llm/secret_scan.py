"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The field tags every token of a text as O (outside), B (begins a secret) or I (goes on in one).
A token's features are its own shape (length, kinds of characters, entropy, how like a word its
letters are), the words before and after it, the signs around it, and what the whole text looks
like. Weights are fitted by gradient ascent on the conditional likelihood of labelled texts;
Viterbi finds the best labels. Labelled texts are generated by :func:`labelled_texts`; anybody
who has real ones passes those to :func:`fit`.

Viterbi steps through a text only where labels are open. Where O leads by more than any moves
and a following I could make good, O is certain, and the chain is cut there without changing
the best labelling. A token's own scores are looked up by the token, so a text costs
a few lookups for each token.

Spans are (kind, start, end) in code points, end exclusive; for an assignment the span is the
assigned value. Spans of the model that touch a pattern's span are left out.

Defined cases: a null text counts as empty; texts of any length are read whole; of equally good
labellings the one with the least labels (O before B before I) from the end counts; equal rows
give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Gaps between tokens, and tokens in the group.
_SPLIT = re.compile(r"""([^\s"'`,;:<>(){}\[\]|=]+)""")
_ENDS = ".!?"
LABELS = 3  # O, B, I
#: Tokens whose scores a process keeps.
KEPT = 300_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, in order."""
    found = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [("assign", *m.span(2)) for m in ASSIGN.finditer(text)]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered([s for s in found if s[2] - s[1] >= LEAST[s[0]]])


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- features ---------------------------------------------------------------------------


_PLAIN_WORD = re.compile(r"[^\W\d_][^\W\d_A-Z]*\Z")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxyzß]+")
_VOWELS = re.compile(r"[aeiouyäöüéèêàáíóúñ]")


def plain_word(t: str) -> tuple[int, int, int] | None:
    """(length, longest run of consonants, fifths of vowels) of a token that is a word of letters,
    with a capital at most in front; its features depend on nothing else."""
    if not _PLAIN_WORD.match(t):
        return None
    low = t.lower()
    hard = max(map(len, _HARD.findall(low)), default=0)
    return min(len(t), 40), min(hard, 7), 5 * len(_VOWELS.findall(low)) // len(t)


def size_feature(n: int) -> str:
    return f"len{n if n < 8 else 8 + min(n // 3, 12)}"


def own_features(token: str) -> list[str]:
    """What a token, without full stops behind it, looks like."""
    t = token[:200]
    n = len(t)
    if not n:
        return ["empty"]
    if word := plain_word(t):
        n, hard, vowels = word
        size = size_feature(n)
        return ["bias", "word", f"word:{size}", f"word:hard{hard}", f"word:vowels{vowels}", f"word:hard{hard}:vowels{vowels}"]
    counts = Counter(t)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits, upper, lower = sum(map(str.isdigit, t)), sum(map(str.isupper, t)), sum(map(str.islower, t))
    marks = n - digits - upper - lower
    kind = "".join(k for k, v in (("d", digits), ("U", upper), ("l", lower), ("m", marks)) if v)
    flips = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(t, t[1:]))
    shape = re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in t))
    size, low = size_feature(n), t.lower()
    hard, vowels = max(map(len, _HARD.findall(low)), default=0), len(_VOWELS.findall(low))
    return [
        "bias", size, f"kind:{kind}", f"{kind}:{size}", f"entropy{int(entropy * 2)}", f"{kind}:flips{min(flips, 9)}", f"digits{digits * 10 // n}", f"marks{min(marks, 4)}", f"shape:{shape}" if len(shape) < 9 else "shape:long",
        f"dots{min(t.count('.'), 3)}", f"dashes{min(t.count('-'), 4)}", f"slash{min(t.count('/'), 3)}", f"under{min(t.count('_'), 3)}", f"at:{'@' in t}", f"hex:{bool(re.fullmatch(r'[0-9a-fA-F]{8,}', t))}",
        f"{kind}:hard{min(hard, 7)}", f"{kind}:vowels{5 * vowels // (upper + lower) if upper + lower else '-'}", f"first:{t[0] if not t[0].isalnum() else '-'}",
    ]


def word_parts(token: str) -> list[str]:
    """The lower-case words of a token, at most four; those of names like db_password too."""
    if plain_word(token):
        return [token.lower()]
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if p and not p.isdigit()][-4:]


def gap_feature(gap: str) -> str:
    """The signs between two tokens."""
    signs = re.sub(r"\s+", "", gap)
    return signs[:3] or ("line" if "\n" in gap else "space" if gap else "none")


def page_features(text: str) -> list[str]:
    """Features of the whole text, which all its tokens share."""
    lines = text.count("\n") + 1
    signs = text.count("=") + text.count("{") + text.count("}") + text.count(";")
    return [f"file:signs{min(3, signs * 4 // lines)}", f"file:begin{'-----BEGIN' in text}"]


#: Features of a token as words around others, by distance: before 1, before 2, before 3 or 4, after.
ROLES = ("prev1", "prev2", "near", "next")


def role_features(token: str, role: str) -> list[str]:
    return [f"{role}:{p}" for p in word_parts(token)] or [f"{role}:-"]


def split_text(text: str) -> tuple[list[str], list[str]]:
    """(tokens, gaps): gaps are one more."""
    parts = _SPLIT.split(text)
    return parts[1::2], parts[0::2]


def chain_features(tokens: list[str], gaps: list[str], shared: list[str]) -> list[list[str]]:
    """All features of each token, for training."""
    out = []
    n = len(tokens)
    tokens = [t.rstrip(_ENDS) for t in tokens]
    for i, t in enumerate(tokens):
        f = own_features(t) + [f"before:{gap_feature(gaps[i])}", f"behind:{gap_feature(gaps[i + 1])}", *shared]
        for role, at in (("prev1", i - 1), ("prev2", i - 2), ("near", i - 3), ("near", i - 4), ("next", i + 1)):
            f += role_features(tokens[at], role) if 0 <= at < n else [f"{role}:edge"]
        out.append(f)
    return out


# ---- the model --------------------------------------------------------------------------


class Crf:
    """A linear chain over O, B, I. Label I follows B or I only."""

    def __init__(self, weights: dict, moves):
        self.weights, self.moves = weights, moves
        self._index: dict[str, int] = {}
        self._gaps: dict[str, int] = {}
        self._made: dict[str, int] = {}

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__init__(**state)

    def score(self, features: list[str]):
        import numpy as np

        total = np.zeros(LABELS)
        for f in features:
            if f in self.weights:
                total += self.weights[f]
        return total

    def _row(self, token: str) -> int:
        """The row of a token in the table of scores, own and in each role. Words that no role
        knows share the row of words that look alike."""
        import numpy as np

        t = token.rstrip(_ENDS)
        looks = plain_word(t)
        key = looks if looks and t.lower() not in self._words else t
        if key not in self._keys:
            if len(self._keys) == len(self._table):
                self._table = np.concatenate((self._table, np.zeros_like(self._table)))
            self._table[len(self._keys)] = [self.score(own_features(t)), *[self.score(role_features(t, r)) for r in ROLES]]
            self._keys[key] = len(self._keys)
        return self._keys[key]

    def _rows(self, tokens: list[str]):
        import numpy as np

        index = self._index
        if not index or len(index) > KEPT:
            self._words = {f.split(":", 1)[1] for f in self.weights if f.split(":", 1)[0] in ROLES}
            self._table = np.zeros((4096, 1 + len(ROLES), LABELS))
            self._table[0, 1:] = [self.score([f"{r}:edge"]) for r in ROLES]
            self._keys = {None: 0}
            index.clear()
            index["\0"] = 0
        for t in tokens:
            if t not in index:
                index[t] = self._row(t)
        return np.array([index[t] for t in tokens], np.int64)

    def _signs(self, gaps: list[str]):
        import numpy as np

        index = self._gaps
        if len(index) > KEPT or not index:
            index.clear()
            self._before, self._behind = [], []
        for g in gaps:
            if g not in index:
                index[g] = len(index)
                self._before.append(self.score([f"before:{gap_feature(g)}"]))
                self._behind.append(self.score([f"behind:{gap_feature(g)}"]))
        if len(self._made) != len(index):
            self._made = index.copy()
            self._both = np.array(self._before), np.array(self._behind)
        rows = np.array([index[g] for g in gaps])
        return self._both[0][rows[:-1]], self._both[1][rows[1:]]

    def emissions(self, tokens: list[str], gaps: list[str], shared: list[str]):
        import numpy as np

        rows = self._rows(tokens)
        table = self._table
        padded = np.concatenate((np.zeros(4, np.int64), rows, np.zeros(1, np.int64)))
        n = len(rows)
        e = table[rows, 0] + table[padded[3 : 3 + n], 1] + table[padded[2 : 2 + n], 2] + table[padded[1 : 1 + n], 3] + table[padded[:n], 3] + table[padded[5 : 5 + n], 4]
        before, behind = self._signs(gaps)
        return e + before + behind + self.score(shared)

    def viterbi(self, e) -> list[int]:
        """The best labels of a chain of emissions that stands between two O."""
        import numpy as np

        score, back = self.moves[0] + e[0], []
        for row in e[1:]:
            step = score[:, None] + self.moves
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        path = [int((score + self.moves[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def open(self, e):
        """Which tokens aren't certainly O: elsewhere O leads by more than two moves, and making
        B of a following I, can cost."""
        import numpy as np

        free = self.moves[self.moves > -1e3]
        later = np.append(np.maximum(0, e[1:, 2] - e[1:, 1]), 0.0)
        return e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= 2 * (free.max() - free.min()) + later

    def labels(self, e):
        """The best labels of a whole text."""
        import numpy as np

        out = np.zeros(len(e), np.int64)
        at = np.flatnonzero(self.open(e))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            out[run] = self.viterbi(e[run])
        return out


def _logsum(a, axis):
    import numpy as np

    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(chains: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.5, l2: float = 3e-6) -> Crf:
    """Gradient ascent on the mean log-likelihood of labelled chains of features. All chains take
    each step of the forward and backward sums together."""
    import numpy as np

    seen = Counter(f for c, _ in chains for fs in c for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    most, n = max(len(y) for _, y in chains), len(chains)
    place, col = [], []
    truth, real = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for k, (c, y) in enumerate(chains):
        truth[k, : len(y)], real[k, : len(y)] = y, True
        for t, fs in enumerate(c):
            own = [index[f] for f in fs if f in index]
            col += own
            place += [k * most + t] * len(own)
    place, col, total = np.array(place), np.array(col), real.sum()
    w, moves = np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS))
    moves[0, 2] = -1e4  # no I after O
    sw, sm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    onehot = np.eye(LABELS)
    last = real.sum(axis=1) - 1
    rows = np.arange(n)
    for _ in range(steps):
        e = np.stack([np.bincount(place, w[col, y], n * most) for y in range(LABELS)], axis=1).reshape(n, most, LABELS)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = moves[0] + e[:, 0]
        for t in range(1, most):
            fwd[:, t] = _logsum(fwd[:, t - 1, :, None] + moves[None], 1) + e[:, t]
        bwd[:, most - 1] = moves[:, 0]
        for t in range(most - 2, -1, -1):
            on = real[:, t + 1, None]
            bwd[:, t] = np.where(on, _logsum(moves[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), moves[None, :, 0])
        z = _logsum(fwd[rows, last] + moves[None, :, 0], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        miss = (onehot[truth] * real[..., None] - p).reshape(-1, LABELS) / total
        grad = np.stack([np.bincount(col, miss[place, y], len(index)) for y in range(LABELS)], axis=1) - l2 * w
        both = np.exp(np.clip(fwd[:, :-1, :, None] + moves[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None], -700, 50)) * real[:, 1:, None, None]
        gm = -both.sum(axis=(0, 1))
        np.add.at(gm, (truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]), 1)
        gm[0] += onehot[truth[:, 0]].sum(axis=0) - p[:, 0].sum(axis=0)
        gm[:, 0] += onehot[truth[rows, last]].sum(axis=0) - p[rows, last].sum(axis=0)
        gm = np.where(moves > -1e3, gm / total, 0)
        sw += grad**2
        sm += gm**2
        w += rate * grad / np.sqrt(sw)
        moves += rate * gm / np.sqrt(sm)
    return Crf({f: w[i].copy() for f, i in index.items()}, moves)


# ---- labelled texts ---------------------------------------------------------------------

_CHUNKS = (
    "th er on an re he in ed nd ha at en es or ti tion ing ment ly st ea wh sh ou ble le la de ar al is to ro ra ne ma lo ver ein sch lich keit ung ge be aus auf ien eau eux aux que oi ai ou elle ció ando ado os as ar mente "
    "pre com per sta ter pla gra bri clo sun win farm house ware gate way light hand book field stone pf tz ch cht nd nt schen heit ö ü ä ß é ó"
).split()
#: Clusters that make long words of few vowels.
_CLUSTERS = "sch pf tz ch cht st nd nt th ly wh sh rst hts ung en er schen lich ö ü ä ß".split()
_NAMES = "password passwd pwd pass passphrase passcode pin secret token key apikey api auth bearer credential credentials private access client authorization login otp code signing license".split()
_FILLER = "the a of to and in for is was with on at by from that this it be are as new old our my your their der die das und le la les de el los un une".split()
_LEADS = ("is", "was", "will be", "set to", "changed to", "", "", "->", "for admin is", "of the server:", "for the account is", "(prod):", "again:")
#: What stands before numbers and codes that are no secrets.
_PLAIN = "order invoice ticket id phone tel fax page room article section figure isbn build version commit sha256 md5 etag checksum request trace session serial model part sku zip case file line row total price year user".split()


def labelled_texts(n: int = 1400, seed: int = 23) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Generated texts with the spans of their secrets, and look-alikes that are none."""
    rng = random.Random(seed)
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    alnum = low + low.upper() + "0123456789"
    some = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    number = lambda a, b: some("0123456789", a, b)
    chance = lambda p: rng.random() < p

    def word(most: int = 4) -> str:
        if chance(0.3):
            return rng.choice(_FILLER)
        made = "".join(rng.choices(_CLUSTERS if chance(0.08) else _CHUNKS, k=rng.randint(1, most)))
        return made.capitalize() if chance(0.15) else made.upper() if chance(0.02) else made

    def strong() -> str:
        """A secret that shows as one by itself."""
        return rng.choice([
            some(alnum, 20, 44), some(hexa, 32, 64), some(hexa.upper(), 32, 40), some(alnum + "+/", 30, 60), f"{some(low, 2, 4)}_{some(alnum, 24, 40)}", f"{some(low, 2, 3)}_{rng.choice(['live', 'test', 'prod'])}_{some(alnum, 24, 30)}",
            f"{some(low, 2, 4)}-{some(alnum, 24, 48)}", ".".join(some(alnum + "-_", 18, 60) for _ in range(3)), some(low + low.upper(), 24, 40),
        ])

    def weak() -> str:
        """A secret that shows by what stands before it."""
        leet = lambda s: s.translate(str.maketrans("aeiost", rng.choice(["4310$7", "@3105t", "43i0st"])))
        return rng.choice([
            some(low + low.upper(), 10, 20), some(low, 10, 24), some(alnum, 8, 19), some(low + "0123456789", 8, 18), number(4, 8), number(9, 18), "-".join(some(low, 4, 4) for _ in range(4)), "-".join(some(low.upper() + "0123456789", 4, 5) for _ in range(rng.randint(3, 5))),
            "".join(word(2).lower() for _ in range(rng.randint(3, 5))), f"{word(2)}{number(1, 4)}{rng.choice(['', '!', '#', '$'])}", leet(word(3)) + number(1, 3), f"{word(2).capitalize()}{rng.choice('!@#$%&*')}{number(2, 4)}", some(alnum + "!@#$%&*?+", 8, 20),
            f"{word(3)}{number(1, 2)}{word(3)}", some(hexa, 8, 15), "-".join(word(2).lower() for _ in range(4)), low[: rng.randint(12, 26)],
        ])

    def other() -> str:
        return rng.choice([
            f"{word()}.{number(1, 2)}@mail{number(1, 1)}.example.com", f"https://www.{word()}.com/{word()}/{number(2, 5)}", f"{word()}-{number(1, 4)}-{word()}", f"v{number(1, 1)}.{number(1, 1)}.{number(1, 2)}-rc{number(1, 1)}", f"{number(4, 4)}-0{number(1, 1)}T12:00:00Z",
            f"{word().upper()}{number(2, 4)}", f"section{number(1, 3)}.{word()}", f"{word()}_{word()}_{number(1, 3)}.txt", number(15, 16), f"{word()}{word()}", f"/{word()}/{word()}{number(1, 2)}/{word()}.py", f"{number(1, 3)}x{number(1, 3)}px", f"{word()}+{word()}{number(1, 1)}",
            f"+{number(1, 2)} {number(3, 3)} {number(3, 3)}-{number(4, 4)}", ".".join(number(1, 3) for _ in range(4)), f"{word()}{word().capitalize()}{word().capitalize()}", f"{word().upper()}_{word().upper()}_{word().upper()}", number(1, 8), f"{number(1, 3)}.{number(2, 2)}", f"{word(6)}{word(6)}", "".join(rng.choices(_CLUSTERS, k=rng.randint(3, 9))), "".join(rng.choices(_CHUNKS, k=rng.randint(5, 12))),
            f"{number(4, 4)}-{number(2, 2)}-{number(2, 2)}", f"{number(2, 2)}/{number(2, 2)}/{number(4, 4)}", f"{word()}###", f"{word()}-{word()}-{word()}-{word()}", f"{word()}'s", f"${number(2, 4)}", f"{number(1, 2)}%", f"{word().upper()}-{number(2, 5)}", f"{number(2, 3)}-{number(2, 4)}-{number(2, 4)}",
        ])

    def led(value: str) -> tuple[str, str]:
        """What stands before a secret, and what ends it."""
        name = rng.choice(_NAMES)
        if chance(0.3):
            name = f"{name} {rng.choice(_NAMES)}"
        if chance(0.35):
            name = rng.choice([f"{word(2)}_{name}", f"{word(2)}-{name}", f"{name}_{number(1, 1)}", f"{word(1)}{name.capitalize()}", name.upper(), name.capitalize(), f"my {name}", f"the {name}", f"{word(2)} {name}"])
        quote = rng.choice(["", "", "", '"', "'", "`"])
        if chance(0.6):
            return f"{name}{rng.choice([': ', '=', ' = ', ':', '\": ', ' := ', ' => '])}{quote}", quote
        return " ".join(f"{name} {rng.choice(_LEADS)}".split()) + f" {quote}", quote

    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 8)):
            text += " ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice([" ", " ", ". ", ", ", "\n"])
            dice = rng.random()
            if dice < 0.22:
                value = weak()
                before, after = led(value)
                text += before
                spans.append((len(text), len(text) + len(value)))
                text += value + after + rng.choice([" ", "\n", ". ", ", ", "; "])
            elif dice < 0.36:
                value = strong()
                value += rng.choice(["", "", "=", "=="]) * (len(value) > 28)
                before, after = rng.choice([("", ""), ("Bearer ", ""), ("Authorization: ", ""), led(value), led(value)])
                text += before
                spans.append((len(text), len(text) + len(value)))
                text += value + after + rng.choice([" ", "\n", ". "])
            elif dice < 0.62:
                text += (f"{rng.choice(_PLAIN)}{rng.choice([' ', ': ', ' = ', '=', ' no. ', ' is ', ' #'])}" if chance(0.5) else "") + other() + rng.choice([" ", "\n", ". ", ", "])
            elif dice < 0.70:
                text += f"{rng.choice(_PLAIN)}{rng.choice([' ', ': ', '=', ' #'])}{rng.choice([number(3, 12), some(hexa, 6, 12), '-'.join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), some(hexa, 40, 40), some(low.upper() + '0123456789', 6, 12)])}{rng.choice([' ', '. ', chr(10)])}"
            elif dice < 0.86:  # the words in plain prose
                text += f"{rng.choice(['the ', 'a ', 'your ', '', ''])}{rng.choice(_NAMES)} {rng.choice(['', '', 'is ', 'was ', 'must be ', 'for ', 'of ', 'to ', ': ', 'should be '])}{word()} {word()}{rng.choice(['. ', ' ', ', '])}"
            elif dice < 0.89:
                text += f"{rng.choice(_NAMES)}{rng.choice([': ', ' = ', '='])}{rng.choice(['required', 'optional', 'none', 'null', 'true', 'false', 'string', 'yes', 'no', 'hidden', 'changed', 'expired', word(1), word(2), '***', '<none>'])}{rng.choice([chr(10), '. ', ' '])}"
            elif dice < 0.91:
                lines = [some(alnum + "+/", 64, 64) for _ in range(rng.randint(2, 4))]
                text += "-----BEGIN PRIVATE KEY-----\n"
                spans.append((len(text), len(text) + sum(map(len, lines)) + len(lines) - 1))
                text += "\n".join(lines) + "\n-----END PRIVATE KEY-----\n"
        yield text, spans


def chains_of(texts: Iterable[tuple[str, list[tuple[int, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the tokens of labelled texts."""
    out = []
    for text, spans in texts:
        tokens, gaps = split_text(text)
        labels, at, within = [], 0, None
        for t, g in zip(tokens, gaps):
            at += len(g)
            own = next((s for s in spans if s[0] < at + len(t) and at < s[1]), None)
            labels.append(0 if own is None else 2 if own == within else 1)
            within = own
            at += len(t)
        if tokens:
            out.append((chain_features(tokens, gaps, page_features(text)), labels))
    return out


_FITTED: list[Crf] = []


def default_model() -> Crf:
    """The model of :func:`labelled_texts`, fitted once in a process."""
    if not _FITTED:
        _FITTED.append(fit(chains_of(labelled_texts())))
    return _FITTED[0]


def model_spans(text: str, model: Crf) -> list[tuple[str, int, int]]:
    import numpy as np

    tokens, gaps = split_text(text)
    if not tokens:
        return []
    labels = model.labels(model.emissions(tokens, gaps, page_features(text)))
    hits = np.flatnonzero(labels)
    if not len(hits):
        return []
    ends = np.cumsum(np.array([len(g) + len(t) for g, t in zip(gaps, tokens)]))
    found: list[list] = []
    for i in hits.tolist():
        end = int(ends[i])
        start = end - len(tokens[i])
        end -= len(tokens[i]) - len(tokens[i].rstrip("."))
        if m := re.match(r"={1,2}(?![^\s\"'`,;.)\]])", text[end : end + 3]):
            end += m.end()
        if labels[i] == 2 and found:
            found[-1][2] = end
        else:
            found.append(["crf", start, end])
    return [tuple(s) for s in found]


def all_spans(text: str, model: Crf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(pattern spans, all spans), each in order."""
    base = base_spans(text)
    more = [s for s in model_spans(text, model) if not any(s[1] < b and a < s[2] for _, a, b in base)]
    return base, ordered(base + more)


def scan(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end, value) for every row."""
    crf = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            both = ([], [])
            for t in batch.column(1).to_pylist():
                text = t or ""
                for out, spans in zip(both, all_spans(text, crf)):
                    out.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, one) for x in both]], ["id", "base", "spans"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}")
