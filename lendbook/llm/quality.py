"""Quality rules kept as a ledger of failure bits.

``ledger`` evaluates every rule once for every document and stores the measurements and one bit
per failed rule. A policy is a version and a mask: applying it, comparing versions and computing
ablations are bitwise operations on the stored bits, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters counted as symbols and the white space between words.
SYMBOLS = "#*$%&|<>"
WHITE_SPACE = " \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper_words", "longest_word")
_MEASURES_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in MEASURES) + ">"
_ARROW_MEASURES = pa.struct([(name, pa.int64()) for name in MEASURES])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first one included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Three word numbers in one key; exact while there are fewer than two million words.
    if len(ids) < 1 << 21:
        windows = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    else:
        _, pairs = np.unique(numbers[:-1] * len(ids) + numbers[1:], return_inverse=True)
        _, windows = np.unique(pairs[:-1] * len(ids) + numbers[2:], return_inverse=True)
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    hits = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[hits + shift] = True
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``; zeros for no text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE_SPACE)]
    upper = sum(map(bytes.isupper, words))
    return (len(words), len(text) - sum(map(text.count, WHITE_SPACE)),
            sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), upper, max(map(len, words), default=0))


def measures(text: Column) -> Column:
    """``MEASURES`` of a text column as a struct."""

    @F.arrow_udf(_MEASURES_TYPE)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [measure_text(text.as_py()) for text in texts]
            columns = list(zip(*rows)) or [()] * len(MEASURES)
            yield pa.StructArray.from_arrays(
                [pa.array(column, pa.int64()) for column in columns],
                fields=list(_ARROW_MEASURES))

    return measured(text)


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the place in ``RULES`` is the bit."""

    name: str
    fails: str


# Bit numbers follow this order and are never reused.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", "100 * n_upper_words > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {rule.name: place for place, rule in enumerate(rules)}
        return sum(1 << places[name] for name in self.rules)


POLICIES = (
    Policy("base", BASE_RULES),
    Policy("v1", BASE_RULES + ("symbols", "duplicate_lines", "capitals")),
    Policy("v2", tuple(rule.name for rule in RULES)),
)
CURRENT = POLICIES[-1]


def fail_bits(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """One bit per failed rule. A text without words fails only ``too_few_words``."""
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0))
    return bits


def ledger(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, the measurements and ``fail_bits``, one row per row of ``df``.

    Null and empty texts measure zero. Null ids, repeated rows and columns of any other name are
    harmless: only the id and the text are read. An empty table gives an empty ledger.
    """
    measured = df.select(F.col(id_col), measures(F.col(text_col)).alias("m"))
    return measured.select(id_col, "m.*").withColumn("fail_bits", fail_bits(rules))


def passes(policy: Policy, bits: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(kept_ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES,
              rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy version and rule: rejected in all, failing the rule, rejected by it alone.

    ``only_this`` is how many documents the policy would win back without the rule. The ledger
    is first counted per bit pattern, of which there are at most 2 ** rules.
    """
    patterns = kept_ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(policy.version, name, policy.mask(rules), Policy("", (name,)).mask(rules))
              for policy in policies for name in policy.rules]
    terms = F.explode(F.array(*[
        F.struct(F.lit(version).alias("version"), F.lit(name).alias("rule"),
                 F.lit(mask).cast("long").alias("mask"), F.lit(bit).cast("long").alias("bit"))
        for version, name, mask, bit in wanted]))
    hit = F.col("fail_bits").bitwiseAND(F.col("t.mask"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return patterns.withColumn("t", terms).groupBy("t.version", "t.rule").agg(
        total(hit != 0).alias("rejected"),
        total(F.col("fail_bits").bitwiseAND(F.col("t.bit")) != 0).alias("failing"),
        total(hit == F.col("t.bit")).alias("only_this"))
