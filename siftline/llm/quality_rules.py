"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule of RULES once for every text and stores the measurements and a long whose bit i says
that rule i failed. Everything after that is arithmetic on the ledger, without the texts: a policy is a version name
and the mask of the rules that it enforces, ``apply_policy`` keeps a row unless ``failures & mask`` has a bit, and
``ablation`` counts, in one aggregation, how many rows each rule alone rejects, how many rows only it rejects (what
dropping the rule would bring back) and how many a policy keeps.

The measurements are taken in one Arrow pass over the texts; nothing shuffles. Windows of eight words are compared by
a 64-bit hash of their words' numbers and equal hashes are confirmed word by word, so the count is exact.

Defined cases. A null text has no words and fails too_few_words. Empty texts are alike. Repeated rows are judged each.
Ids may be null or repeated. An empty table gives an empty ledger and an ablation of zero counts. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long"


@dataclass(frozen=True)
class Rule:
    """A row fails where ``fails`` is true; ``bit`` never changes its meaning, retired bits are not used again."""

    bit: int
    name: str
    fails: str


#: Bits 0 and 1 are the base; the rest are ours.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "shouting", "n_letters >= 40 and 10 * n_upper > 6 * n_letters"),
    Rule(7, "few_letters", "2 * n_letters < word_chars"),
)
BASE = 0b11
#: Policies are versions: a change of mind is a new entry, so that old verdicts can be had again from an old ledger.
POLICIES = {"base": BASE, "v1": 0b11111111}

_CLASS = np.zeros(256, np.uint8)  # by byte: 1 symbol, 2 upper-case ASCII letter, 3 lower-case ASCII letter, 4 later byte of a character
_CLASS[list(SYMBOLS)] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[128:192] = 2, 3, 4
_BLANKS = b" \t\n\r\x0b\x0c"
_WEIGHTS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for i, weight in enumerate(_WEIGHTS):
        hashes += mixed[i : i + n] * weight
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return 0
    twice = order[np.union1d(same, same + 1)]
    seen: dict[bytes, int] = {}
    full = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    for at in twice:  # confirmed by the words themselves
        key = full[at].tobytes()
        seen[key] = seen.get(key, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for at in twice:
        if seen[full[at].tobytes()] > 1:
            edges[at] += 1
            edges[at + WINDOW] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of MEASURES for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # at ASCII white space alone
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=5)
    blanks = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    chars = len(data) - int(kinds[4])
    lines, seen, dup = data.split(b"\n"), set(), 0
    filled = [x for x in lines if x.strip(_BLANKS)]
    for line in filled:
        dup += line in seen
        seen.add(line)
    high = chars - int((np.frombuffer(data, np.uint8) < 128).sum())  # characters beyond ASCII
    upper = int(kinds[2])
    letters = upper + int(kinds[3]) + high
    return len(words), chars - blanks, int(kinds[1]), len(filled), dup, repeated_window_words(words), upper, letters


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements as a struct ``measures``."""

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [m.split()[0] for m in MEASURES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([measure(t) for t in batch], columns=names, dtype="int64")

    return docs.withColumn("measures", measures(F.col(text_col)))


def failure_bits(measures: str = "measures") -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        fails = F.expr(_qualified(rule.fails, measures))
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _qualified(condition: str, measures: str) -> str:
    for name in sorted((m.split()[0] for m in MEASURES.split(", ")), key=len, reverse=True):
        condition = " ".join(f"{measures}.{w}" if w == name else w for w in condition.split())
    return condition


def ledger(docs: DataFrame, text_col: str = "text", version: str = "r1") -> DataFrame:
    """``docs`` without its text, with measures, failures (one bit for each rule) and rules_version; columns of these names
    are replaced."""
    rows = measured(docs, text_col).drop(text_col)
    return rows.withColumns({"failures": failure_bits(), "rules_version": F.lit(version)})


def apply_policy(rows: DataFrame, policy: str = "v1", column: str = "kept") -> DataFrame:
    """Adds whether the policy keeps the row: integer arithmetic on the stored bits."""
    return rows.withColumn(column, F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that fail it alone, rows kept with and without it."""
    mask = POLICIES[policy]
    hit = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    patterns = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("rows"))  # 2 ** rules rows at most
    rules = [r for r in RULES if mask >> r.bit & 1]
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))
    sums = [count(F.getbit("hit", F.lit(r.bit)) == 1).alias(f"f{r.bit}") for r in rules]
    sums += [count(F.col("hit") == 1 << r.bit).alias(f"o{r.bit}") for r in rules]
    one = patterns.agg(count(F.col("hit") == 0).alias("kept"), *sums)
    rows_of = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("fails"), F.col(f"o{r.bit}").alias("fails_alone"), F.col("kept").alias("kept_with"), (F.col("kept") + F.col(f"o{r.bit}")).alias("kept_without")) for r in rules]
    return one.select(F.inline(F.array(*rows_of)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0
    m = [F.col(f"measures.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *m, base.alias("base_failed"), "kept", "failures")


_CHECKS = " ".join(f"+ CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (SELECT row_no, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
      FROM d, unnest(range(1, len(words) - {WINDOW} + 2)) AS u(i)),
r AS (SELECT row_no, i FROM w QUALIFY count(*) OVER (PARTITION BY row_no, win) > 1),
c AS (SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest(range(0, {WINDOW})) AS u(k) GROUP BY row_no),
l AS (SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM d, unnest(string_split(text, chr(10))) AS u(line)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
m AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) AS n_letters
  FROM d LEFT JOIN l USING (row_no) LEFT JOIN c USING (row_no)),
f AS (SELECT *, CAST(0 {_CHECKS} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & {BASE} <> 0 AS base_failed, failures & {POLICIES["v1"]} = 0 AS kept, failures
FROM f
"""
