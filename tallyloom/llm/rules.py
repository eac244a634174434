"""Rule bitmask ledger: every quality rule is evaluated once per document; policies are bit masks over the result.

``ledger`` writes down, per document, the measurements and one bit per failed rule. ``apply_policy`` turns a
versioned policy (a set of rules) into a verdict with one bitwise test, and ``ablations`` reads from the same bits
what each rule of a policy alone decides, so no text is read again when a policy changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import SPACE, Texts, mix, shingles

#: The characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs",
    "n_same_next",
]


@dataclass(frozen=True)
class Rule:
    """A document fails when ``100 * measure > percent * of``; ``few`` rules fail when ``measure < least``."""

    name: str
    measure: str
    of: str | None = None
    percent: int = 0
    least: int = 0

    def failed(self) -> Column:
        if self.of is None:
            return F.col(self.measure) < self.least
        return F.col(self.measure) * 100 > F.col(self.of) * self.percent


#: The bit of a rule is its place here; append new rules, never reorder.
RULES = [
    Rule("few_words", "n_words", least=20),
    Rule("repeated_words", "n_repeat_words", "n_words", 30),
    Rule("symbols", "n_symbols", "n_words", 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 30),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("upper_case", "n_upper", "word_chars", 30),
    Rule("exclamations", "n_bangs", "n_words", 30),
    Rule("stutter", "n_same_next", "n_words", 20),
]

#: Policy name -> names of the rules it applies.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": [r.name for r in RULES],
}


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask_of(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def _per_text(texts: Texts, hit: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=upto[1:])
    return upto[texts.offsets[1:]] - upto[texts.offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which occurred before (in order)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    often = same.copy()
    often[:-1] |= same[1:]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], before[order] = often, same
    return twice, before


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """All measurements for a slice of texts."""
    d, n = texts.data, len(texts)
    starts, ends = texts.words()
    owner = texts.owner(starts)
    counts = np.bincount(owner, minlength=n)
    out = {
        "n_words": counts,
        "word_chars": _per_text(texts, (d & 0xC0) != 0x80) - _per_text(texts, SPACE[d]),
        "n_symbols": _per_text(texts, SYMBOLS[d]),
    }
    # lines: from the start of a text or after a \n, up to the next \n or the end of the text
    breaks = np.flatnonzero(d == 10)
    lines = np.unique(np.concatenate((texts.offsets[:-1][np.diff(texts.offsets) > 0], breaks + 1)))
    lines = lines[lines < len(d)]
    line_owner = texts.owner(lines)
    stop = np.minimum(np.concatenate((breaks, [len(d)]))[np.searchsorted(breaks, lines)], texts.offsets[line_owner + 1])
    words_upto = np.searchsorted(starts, stop) - np.searchsorted(starts, lines)
    full = words_upto > 0
    lines, stop, line_owner = lines[full], stop[full], line_owner[full]
    salt = mix(np.arange(n, dtype=np.uint64))
    _, before = _again(texts.hashes(lines, stop) ^ salt[line_owner])
    out["n_dup_lines"] = np.bincount(line_owner[before], minlength=n)
    # words in windows that the text holds twice or more
    hashes = texts.hashes(starts, ends)
    long = np.where(counts >= WINDOW, counts, 0)
    chosen = np.repeat(long > 0, counts)
    windows, made = shingles(hashes[chosen], long[long > 0], WINDOW)
    first_word = np.concatenate(([0], np.cumsum(counts)))[:-1][long > 0]
    begin = np.repeat(first_word - np.cumsum(made) + made, made) + np.arange(len(windows))
    twice, _ = _again(windows ^ np.repeat(salt[long > 0], made))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_upper"] = _per_text(texts, (d >= 65) & (d <= 90))
    out["n_bangs"] = _per_text(texts, d == 33)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = np.bincount(owner[same], minlength=n)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def ledger(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the measurements and ``failed_bits`` with one bit per rule of RULES.

    A null or empty text has zero measurements; it fails ``few_words`` only. Repeated ids stay separate rows; other
    columns are ignored; an empty table gives no rows.
    """

    def each(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            yield {id_column: batch.column(0).slice(first, end - first)} | measure(texts)

    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = arrow_map(docs, [id_column, text], each, schema)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(bit(rule.name)).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """Adds the verdict of a policy: kept when none of its rules failed."""
    return rows.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many documents fail it, how many fail only it (they come back when the rule is
    left out), and how many fail it and some other rule; from the ledger's bits in one aggregation."""
    mask = mask_of(policy)
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = []
    for name in POLICIES[policy]:
        own = F.lit(bit(name)).cast("long")
        sums += [
            F.sum(F.when(hit.bitwiseAND(own) != 0, 1).otherwise(0)).alias(f"{name}_fails"),
            F.sum(F.when(hit == own, 1).otherwise(0)).alias(f"{name}_alone"),
        ]
    total = rows.agg(*sums)
    return total.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.coalesce(F.col(f"{name}_fails"), F.lit(0)).cast("long").alias("n_failed"),
                        F.coalesce(F.col(f"{name}_alone"), F.lit(0)).cast("long").alias("n_back_without"),
                    )
                    for name in POLICIES[policy]
                ]
            )
        )
    )
