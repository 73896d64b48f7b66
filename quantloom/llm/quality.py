"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once a document; the ledger stores the measurements and one long whose bit k
says that rule k failed. A policy is a version and the rules that it enforces: applying one, or
another, is a bitwise and, and ablations (what each rule alone would drop, drops that no other rule
shares, what a policy would keep without it) are sums over bits of the stored ledger, with no text read again.

Edge cases: null, empty and blank texts have no words: all measurements are 0, and they fail
`few_words`. Windows and lines are compared within a text only, so a row is one task's work however
long it is, and no shuffle is needed; repeated rows each get their row. Further columns of the input
are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what further rules need."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # with a blank at either end, the first and last pieces are always empty
    words = F.split(F.concat(F.lit(" "), "text", F.lit(" ")), r"[\x20\x09-\x0D]+")
    rows = texts.withColumn("words", words).withColumn("n_words", (F.size("words") - 2).cast("long"))
    rows = rows.withColumn("glued", F.array_join("words", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD))
    rows = rows.withColumn("lines", lines)
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("h", hashed)
    # words[0] is the empty piece: window i (1-based) has words i .. i + 4
    window = F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - WINDOW + 1),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("windows", F.when(F.col("n_words") > WINDOW, window))
    # only texts with a repeated window pay for sorting
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    paired = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(some, paired))
    repeated = F.filter(
        F.transform("sorted", lambda p, k: F.when((p["w"] == F.get("sorted", k - 1)["w"]) | (p["w"] == F.get("sorted", k + 1)["w"]), p["i"])),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("at", F.array_sort(repeated))
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.length("glued").cast("long").alias("word_chars"),
        F.length("glued").cast("long").alias("_all"),
        (F.length("glued") - F.length(F.translate("glued", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("glued", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.floor((F.length("glued") - F.length(F.replace("glued", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
    ).drop("_all")


@dataclass(frozen=True)
class Rule:
    """Fails where the expression holds; bit is its place in the ledger and never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "capitals", "2 * n_capitals > word_chars"),
    Rule(5, "shouting", "10 * n_shouts > n_words"),
    Rule(6, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
#: The first two rules are the base that every policy has.
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules=RULES) -> int:
        by_name = {r.name: r.bit for r in rules}
        return sum(1 << by_name[name] for name in self.rules)


POLICIES = (
    Policy("2024-base", ("few_words", "repeated_windows")),
    Policy("2024-lines", ("few_words", "repeated_windows", "symbols", "duplicate_lines")),
    Policy("2025-full", tuple(r.name for r in RULES)),
)


def ledger(docs: DataFrame, rules=RULES, **columns) -> DataFrame:
    """The measurements and fail_bits of each document."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return measured(docs, **columns).withColumn("fail_bits", bits)


def kept(bits: Column, policy: Policy, rules=RULES) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(entries: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """For each policy and rule: documents, kept, failed by the rule, failed by it alone, kept without it.

    One aggregation over the ledger: rows are first counted by fail_bits (2 ** rules at most).
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plans = F.array(
        *[
            F.struct(
                F.lit(p.version).alias("policy"),
                F.lit(p.mask(rules)).cast("long").alias("mask"),
                F.lit(r.name).alias("rule"),
                F.lit(1 << r.bit).cast("long").alias("bit"),
            ) for p in policies for r in rules if r.name in p.rules
        ]
    )
    each = counts.select("n", "fail_bits", F.explode(plans).alias("p")).select("n", "fail_bits", "p.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"),
        total(failed == 0).alias("kept"),
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(failed == F.col("bit")).alias("failed_alone"),
        total(failed.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
