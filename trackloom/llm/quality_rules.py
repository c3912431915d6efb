"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document over a set of measurements. The ledger keeps the
measurements and one bit for each failed rule. Policies are versioned masks over those bits;
changing a policy, or asking what a rule contributes, reads the ledger and never the text.

Defined cases: a null text has no words; an empty table gives an empty ledger; repeated rows
get a ledger row each; other columns of the input are ignored by :func:`ledger` and passed
through by :func:`quality_filter`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the struct of measurements. A rule keeps its bit for ever."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    Rule(4, "shouting", lambda m: 100 * m["n_upper"] > 30 * m["word_chars"]),
    Rule(5, "word_length", lambda m: (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
)
BASE = Policy("base", ("too_few_words", "repeated_windows"))
STRICT = Policy("2", tuple(r.name for r in RULES))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(policy.rules))


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by a
    64-bit hash within one document. Sorting shows the hashes that occur twice; if they are
    few, each window is looked up among them, else hashes are sorted with their positions."""

    def starts(hashes: Column, twins: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = let(keyed, lambda s: F.filter(s, lambda x, k: same(F.get(s, k + 1), x) | same(F.get(s, k - 1), x)))
        few = F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(twins, h), i)))
        return F.when(F.size(twins) <= 64, few).otherwise(F.sort_array(F.transform(many, lambda x: x["i"])))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda s, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - s), F.lit(3)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        twins = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.coalesce(F.get(s, k + 1) == h, F.lit(False)))))
        return let(twins, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(let(starts(hashes, t), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, count))


def measurements(text: Column) -> Column:
    """A struct of MEASURES; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    def over(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - kept(r"[#*$%&|<>]+")).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            kept(r"[^\p{Lu}]+").alias("n_upper"),
        )

    return let(words(text), over)


def failure_bits(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit for each failed rule, over a struct of measurements."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES, failure_bits) for every row, without a shuffle."""
    entry = let(measurements(F.col(text_col)), lambda m: F.struct(*[m[x].alias(x) for x in MEASURES], failure_bits(m, rules).alias("failure_bits")))
    return docs.select(F.col(id_col), entry.alias("m")).select(id_col, "m.*")


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def kept_without(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failure_bits") -> Column:
    """The bits of those rules of a policy without any one of which it would keep the row: all of them
    if it keeps it anyway, the one rule that alone rejects it, else none."""
    mine = F.col(bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    out = F.lit(0).cast("long")
    for r in rules:
        if r.name in policy.rules:
            out = out.bitwiseOR(F.when(mine.bitwiseAND(F.lit(~(1 << r.bit)).cast("long")) == 0, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the
    policy would keep without it. The ledger is first summed by failure pattern, of which
    there are at most two to the number of rules."""
    whole = mask(policy, rules)
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    mine = [r for r in rules if r.name in policy.rules]
    each = patterns.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in mine])))
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)
    bit = F.col("rule.bit")
    return each.groupBy(F.col("rule.name").alias("rule")).agg(
        n(F.col("bits").bitwiseAND(bit) != 0, "failing"), n(F.col("bits") == bit, "failing_alone"), n(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, "kept_without")
    )


def quality_filter(docs: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their columns as they were."""
    bits = let(measurements(F.col(text_col)), lambda m: failure_bits(m, rules))
    return docs.where(bits.bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)
