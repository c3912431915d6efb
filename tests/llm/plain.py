"""Plain versions of the corpus stages, one document at a time, to hold the operators against."""

import hashlib
import re
from collections import Counter


def keeps(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(zip(w, w[1:], w[2:]))
    again = len({k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    upper = sum(c.isupper() for c in text or "")
    bad = [
        len(w) < 50, 100 * again > 50 * len(w), 100 * len(re.findall(r"[#*$%&|<>]", text or "")) > 10 * len(w),
        len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines), 100 * upper > 30 * chars, chars > 25 * len(w) or chars < 2 * len(w),
    ]
    return not any(bad)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(text, items):
    """Whether some window of 13 words, or a whole shorter item of 8 or more, agrees in 0.8."""
    w = words(text)
    for item in items:
        t = words(item)
        if len(t) < 8:
            continue
        k = min(13, len(t))
        for shift in range(-len(t), len(w)):
            eq = [t[p] == w[p + shift] for p in range(len(t)) if 0 <= p + shift < len(w)]
            if len(eq) >= k and any(10 * sum(eq[s : s + k]) >= 8 * k for s in range(len(eq) - k + 1)):
                return True
    return False


def prf(key, tweak, i, x):
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(a, b, mods, tweak, key):
    for i in range(10):
        m = mods[i % 2]
        a, b = b, (a + prf(key, tweak, i, b) % m) % m
    return a, b


def permuted(digits, tweak, key):
    n = len(digits)
    u = n // 2
    a, b = feistel(int(digits[:u]), int(digits[u:]), (10**u, 10 ** (n - u)), f"{tweak}:{n}", key)
    return f"{a:0{u}d}{b:0{n - u}d}"


def check_digit(payload):
    return str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload))) % 10)


def poured(shape, fill, takes="[0-9]"):
    it = iter(fill)
    return "".join(next(it) if re.match(takes, c) else c for c in shape)


def pseudonym(text, key):
    """Cards, phones with a plus sign, IPv4 addresses and e-mail addresses, as they occur in the
    shared documents."""

    def email(m):
        local, domain = m.group().split("@")
        hexes = "".join(hashlib.sha256(f"{key}|email|{i + 1}|{m.group().lower()}".encode()).hexdigest() for i in range(-(-len(local) // 64)))
        letters = hexes.translate(str.maketrans("0123456789", "ghijklmnop"))
        return poured(poured(local, letters, "[A-Za-z]"), hexes.translate(str.maketrans("abcdef", "012345"))) + "@" + domain

    def ip(m):
        o = list(map(int, m.group().split(".")))
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def phone(m):
        rest = m.group()[2:]
        return m.group()[:2] + poured(rest, permuted(re.sub(r"\D", "", rest), "phone", key))

    def card(m):
        d = m.group()
        if check_digit(d[:-1]) != d[-1]:
            return d
        p = permuted(d[:-1], "card", key)
        return p + check_digit(p)

    kinds = [
        (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
        (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
        (r"(?<![\w+])\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)", phone),
        (r"(?<!\w)\d{13,19}(?!\w)", card),
    ]
    any_kind = "|".join(f"({p})" for p, _ in kinds)
    return re.sub(any_kind, lambda m: kinds[m.lastindex - 1][1](m), text, flags=re.A)
