"""Format-preserving Feistel pseudonyms for private values.

Card numbers (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4
addresses and calendar dates are found, validated, and replaced by another value of the same
format: a keyed Feistel network permutes the value's own domain, so equal values become equal
pseudonyms in every document, different values stay different, and whoever has the key can go
back. Separators and layout stay. Check digits are made to fit. Local parts of e-mail
addresses, which have no numeric domain, become keyed letters and digits of the same layout
(linked, but not reversible).

All of it is DataFrame functions: matches and the text between them are taken by the same
pattern and joined again in order.

A card or IBAN may stand beside other groups of digits or capitals (an expiry date, a code, a
word): a match that fails its check is searched for parts at its separators that pass. Runs of
more than 49 digits are searched piece by piece.

Defined cases: a null text stays null with no matches; an empty text stays empty; numbers that
fail their check, and hold no part that passes, stay as they are; equal rows give equal rows; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import let

#: For tests and demonstrations; production passes a secret.
DEMO_KEY = "trackloom-demonstration-key"
ROUNDS = 10
#: Dates are permuted over these days: 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DATE_LEFT, DATE_RIGHT = "1900-01-01", 17, 4297

#: Characters of an IBAN by country; other countries' may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: First digits and lengths of card brands, for cards beside other digits.
BRANDS = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|(?:5[06-9]|6)\d{12,18})$"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "card": r"(?<![\w])\d(?:[ -]?\d){12,48}(?![\w])",
}


def _long(x: Column) -> Column:
    return x.cast("long")


def _ten(n: Column) -> Column:
    return _long(F.concat(F.lit("1"), F.repeat(F.lit("0"), n)))


def feistel(left: Column, right: Column, mods: tuple[Column, Column], tweak: Column, key: str, back: bool = False) -> Column:
    """struct(l, r) for a pair of numbers below the two moduli: a keyed permutation of those
    pairs, or its inverse. An even number of rounds brings each modulus back to its side."""

    def keyed(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i, x), 256)
        return _long(F.conv(F.substring(digest, 1, 15), 16, 10))

    start = F.struct(_long(left).alias("l"), _long(right).alias("r"))
    mod = lambda i: F.when(i % 2 == 0, mods[0]).otherwise(mods[1])
    if not back:
        step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(keyed(i, s["r"]), mod(i)), mod(i)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    undo = lambda s, i: F.struct(F.pmod(s["r"] - F.pmod(keyed(i, s["l"]), mod(i)), mod(i)).alias("l"), s["l"].alias("r"))
    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), start, undo)


def permute_digits(digits: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """Another string of as many digits (2 to 36), by a keyed permutation."""

    def over(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        v = n - u
        pair = feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1, v), (_ten(u), _ten(v)), F.concat_ws(":", tweak, n), key, back)
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, "0"), F.lpad(p["r"].cast("string"), v, "0")))

    return let(digits, over)


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit a Luhn number."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, _long(c) * 2 - F.when(_long(c) > 4, 9).otherwise(0)).otherwise(_long(c))),
        F.lit(0).cast("long"),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def iban_mod(text: Column) -> Column:
    """The remainder of a rearranged IBAN by 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), _long(c)).otherwise(_long(F.ascii(c)) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _pour(shape: Column, fill: Column, takes: str = "[0-9]") -> Column:
    """``shape`` with its characters of a class replaced in order by those of ``fill``."""
    put = lambda s, c: F.when(c.rlike(takes), F.struct(F.concat(s["out"], F.substr(fill, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))
    )
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str, back: bool) -> Column:
    def over(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        other = let(permute_digits(payload, F.lit("card"), key, back), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(F.length(d).between(13, 19) & (luhn_digit(payload) == F.right(d, F.lit(1))), let(other, lambda o: _pour(m, o)))

    return let(_digits(m), over)


def _cards(m: Column, key: str, back: bool) -> Column:
    """struct(text, n) for a run of digit groups that isn't a card as a whole: the leftmost,
    then longest groups that make a card of a known brand, again and again; what is left
    between them is searched for the other kinds."""
    n = F.length(m)
    at = lambda p: F.substr(m, p, F.lit(1))
    inside = lambda a, b: F.substr(m, a, b - a + 1)

    def valid(c: Column) -> Column:
        d = _digits(inside(c["s"], c["e"]))
        brand = F.lit(True) if back else d.rlike(BRANDS)
        return F.length(d).between(13, 19) & brand & (luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)))

    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda p: (p == 1) | at(p - 1).isin(" ", "-"))
    ends = F.reverse(F.filter(places, lambda p: (p == n) | at(p + 1).isin(" ", "-")))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: (e - s).between(12, 36)), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    none = F.array().cast("array<struct<s:int,e:int>>")
    taken = F.aggregate(F.filter(spans, valid), none, lambda got, c: F.when((F.size(got) == 0) | (c["s"] > F.element_at(got, -1)["e"]), F.concat(got, F.array(c))).otherwise(got))

    def over(got: Column) -> Column:
        all_ = F.concat(got, F.array(F.struct((n + 1).alias("s"), n.alias("e"))))
        before = F.concat(F.array(F.lit(0)), F.transform(got, lambda c: c["e"]))
        rest = {k: KINDS[k] for k in ("date", "ssn", "phone")}
        gap = lambda c, b: _scan(inside(b + 1, c["s"] - 1), key, back, rest)
        made = F.zip_with(all_, before, lambda c, b: F.struct(gap(c, b).alias("gap"), F.coalesce(_card(inside(c["s"], c["e"]), key, back), F.lit("")).alias("card")))

        def joined(x: Column) -> Column:
            text = F.array_join(F.transform(x, lambda p: F.concat(p["gap"]["text"], p["card"])), "")
            return F.struct(text.alias("text"), (F.aggregate(x, F.lit(0).cast("long"), lambda a, p: a + p["gap"]["n"]) + F.size(got)).alias("n"))

        return let(made, joined)

    return let(taken, over)


def _iban(m: Column, key: str, back: bool) -> Column:
    def over(bare: Column) -> Column:
        country, rest = F.substring(bare, 1, 2), F.substr(bare, F.lit(5), F.length(bare))
        other = let(permute_digits(_digits(rest), F.concat(F.lit("iban"), country), key, back), lambda d: _pour(rest, d))
        whole = let(other, lambda r: F.concat(country, F.lpad((98 - iban_mod(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
        return F.when((iban_mod(F.concat(rest, F.substring(bare, 1, 4))) == 1) & (F.length(_digits(rest)) >= 2), let(whole, lambda w: _pour(m, w, "[A-Z0-9]")))

    return let(F.replace(m, F.lit(" "), F.lit("")), over)


def _iban_before(m: Column, key: str, back: bool) -> Column:
    """struct(text, n) for a match that isn't an IBAN as a whole: the longest part before a
    space that is one, and the rest searched for the other kinds."""
    whole = KINDS["iban"]
    ends = F.reverse(F.filter(F.sequence(F.lit(1), F.length(m) - 1), lambda p: F.substr(m, p + 1, F.lit(1)) == " "))
    made = F.transform(ends, lambda e: F.struct(F.when(F.substr(m, F.lit(1), e).rlike(f"^(?:{whole})$"), _iban(F.substr(m, F.lit(1), e), key, back)).alias("text"), e.alias("e")))
    rest = {k: v for k, v in KINDS.items() if k != "iban"}

    def over(first: Column) -> Column:
        tail = _scan(F.substr(m, first["e"] + 1, F.length(m)), key, back, rest)
        put = let(tail, lambda t: F.struct(F.concat(first["text"], t["text"]).alias("text"), (t["n"] + 1).alias("n")))
        return F.when(first.isNotNull(), put)

    return let(F.get(F.filter(made, lambda x: x["text"].isNotNull()), F.lit(0)), over)


def _ip(m: Column, key: str, back: bool) -> Column:
    def over(o: Column) -> Column:
        half = lambda i: _long(F.get(o, i)) * 256 + _long(F.get(o, i + 1))
        side = F.lit(65536).cast("long")
        text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("long"), x % 256)
        return let(feistel(half(0), half(2), (side, side), F.lit("ip"), key, back), lambda p: F.concat_ws(".", text(p["l"]), text(p["r"])))

    return let(F.split(m, r"\."), over)


def _date(m: Column, key: str, back: bool) -> Column:
    """Dates with slashes are month first where that is a date, else day first."""
    first = F.to_date(F.lit(FIRST_DAY))
    total = DATE_LEFT * DATE_RIGHT

    def by(form: str) -> Column:
        def over(n: Column) -> Column:
            pair = feistel(F.floor(n / DATE_RIGHT), n % DATE_RIGHT, (F.lit(DATE_LEFT).cast("long"), F.lit(DATE_RIGHT).cast("long")), F.lit("date"), key, back)
            day = let(pair, lambda p: F.date_format(F.date_add(first, (p["l"] * DATE_RIGHT + p["r"]).cast("int")), form))
            return F.when((n >= 0) & (n < total), day)

        return let(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first), over)

    return F.when(F.contains(m, F.lit("-")), by("yyyy-MM-dd")).when(F.contains(m, F.lit(".")), by("dd.MM.yyyy")).otherwise(F.coalesce(by("MM/dd/yyyy"), by("dd/MM/yyyy")))


def _ssn(m: Column, key: str, back: bool) -> Column:
    """Going back, any nine digits may be a pseudonym."""
    valid = F.lit(True) if back else ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, let(permute_digits(_digits(m), F.lit("ssn"), key, back), lambda d: _pour(m, d)))


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code after a plus sign stays."""

    def over(prefix: Column) -> Column:
        rest = F.substr(m, F.length(prefix) + 1, F.length(m))
        other = let(permute_digits(_digits(rest), F.lit("phone"), key, back), lambda d: F.concat(prefix, _pour(rest, d)))
        return F.when(F.length(_digits(rest)).between(6, 15), other)

    return let(F.regexp_extract(m, r"^(?:\+1(?=[ .(-])|\+\d{1,3}(?=[ .(-])|\+\d)?", 0), over)


def _email(m: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    whole = F.ceil(n / 64).cast("int")
    hexes = F.array_join(F.transform(F.sequence(F.lit(1), whole), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i, F.lower(m)), 256)), "")
    letters, digits = F.translate(hexes, "0123456789", "ghijklmnop"), F.translate(hexes, "abcdef", "012345")
    if back:
        return F.lit(None).cast("string")
    return let(_pour(local, letters, "[A-Za-z]"), lambda x: F.concat(_pour(x, digits), F.lit("@"), domain))


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
#: What else a match may hold that isn't a value as a whole.
_PARTS = {"iban": _iban_before, "card": _cards}


def replace_match(m: Column, key: str, back: bool = False, kinds: dict[str, str] = KINDS) -> Column:
    """struct(text, n): the pseudonym of a match (or what it stands for) and the values
    replaced in it; null if its check fails."""
    found = F.lit(None).cast("struct<text:string,n:bigint>")
    for kind, pattern in reversed(kinds.items()):
        one = let(_MAKE[kind](m, key, back), lambda x: F.when(x.isNotNull(), F.struct(x.alias("text"), F.lit(1).cast("long").alias("n"))))
        if kind in _PARTS:
            one = F.coalesce(one, _PARTS[kind](m, key, back))
        found = F.when(m.rlike(f"^(?:{pattern})$"), one).otherwise(found)
    return found


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_private): each text with its private values replaced."""
    return docs.select(F.col(id_col), _replaced(F.col(text_col), key).alias("r")).select(id_col, F.col("r.text").alias(text_col), F.col("r.n").alias("n_private"))


def _scan(text: Column, key: str, back: bool, kinds: dict[str, str]) -> Column:
    """struct(text, n) with the values of some kinds replaced."""
    anyone = "|".join(kinds.values())

    def over(made: Column, found: Column) -> Column:
        parts = F.zip_with(F.split(text, anyone, -1), F.zip_with(made, found, lambda a, b: F.coalesce(a["text"], b)), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
        n = F.aggregate(made, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0).cast("long")))
        return F.struct(F.array_join(parts, "").alias("text"), n.alias("n"))

    changed = let(F.regexp_extract_all(text, F.lit(anyone), F.lit(0)), lambda found: let(F.transform(found, lambda m: replace_match(m, key, back, kinds)), lambda made: over(made, found)))
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike("[0-9@]"), changed).otherwise(same)


def _replaced(text: Column, key: str, back: bool = False) -> Column:
    return _scan(text, key, back, KINDS)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with private values of its text replaced and all columns as they were."""
    return docs.withColumn(text_col, _replaced(F.col(text_col), key)["text"])


def originals(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms taken back, but for e-mail addresses. Only for texts in which
    all values of these kinds are pseudonyms. A card that stood beside other digits goes back only
    if no other groups of its run pass the check."""
    return docs.withColumn(text_col, _replaced(F.col(text_col), key, True)["text"])
