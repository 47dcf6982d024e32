"""Quality rules: learned decision lists over text statistics.

Sequential covering learns an ordered list of rules for bad documents. A rule is grown, one
threshold condition after the other, by information gain on one part of the labelled rows, then
pruned from its end on the other part, and kept if it is precise and has support. Thresholds lie
in the middle between what good and bad rows have, and a condition has to change the share of bad
rows by more than chance would. The list becomes one Spark conditional expression. Rules speak of
statistics of whole texts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import holds

#: Labelled documents that a list is learned from at most, by order of a hash of doc_id.
SAMPLE = 4000
#: Bad rows that a rule has to catch, in all and of those that it grows on.
SUPPORT, GROWN = 5, 3
#: Thresholds of a statistic that are tried for a condition: those between the most rows. A bound of
#: the work of learning, not of the rows that are judged.
CUTS = 64
#: What a condition's likelihood ratio has to pass (one degree of freedom, 99 %).
CHANCE = 6.63
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same")
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    base = len(known)
    codes = ids[:n]
    top = base
    for k in range(1, window):
        if top > (1 << 62) // base:  # number the codes anew so that they stay exact
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            top = int(codes.max()) + 1
        codes = codes * base + ids[k : k + n]
        top *= base
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` of a whole text; zeros for null."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    n_upper = len(data) - len(data.translate(None, _UPPER))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return len(words), chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), n_upper, data.count(b"!"), same


_COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@F.arrow_udf(_COUNT_TYPE)
def _counts(texts: pa.Array) -> pa.Array:
    holds("quality")
    rows = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))], list(COUNTS))


def counts(text: Column) -> Column:
    """Struct of the counts of whole texts."""
    return _counts(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def ratios(c: Column) -> dict[str, Column]:
    """What rules may speak of; every ratio is 0 for texts without words."""
    over = lambda a, b: F.coalesce(c[a].cast("double") / F.nullif(c[b], F.lit(0)), F.lit(0.0))
    return {
        "symbols": over("n_symbols", "word_chars"),
        "capitals": over("n_upper", "word_chars"),
        "marks": over("n_marks", "word_chars"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "same_next": over("n_same", "n_words"),
        "word_length": over("word_chars", "n_words"),
        "words": c["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.limit if self.above else x <= self.limit

    def expression(self, values: dict[str, Column]) -> Column:
        limit = F.lit(self.limit)
        return values[self.name] > limit if self.above else values[self.name] <= limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table[c.name]) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def midpoints(x: np.ndarray, bad: np.ndarray, most: int = CUTS) -> list[tuple[float, float]]:
    """(threshold, gap) between neighbouring values with other shares of bad rows.

    Of more than ``most`` those that lie at equal steps through the rows.
    """
    values, first, counts = np.unique(x, return_index=True, return_counts=True)
    if len(values) < 2:
        return []
    share = np.bincount(np.searchsorted(values, x), weights=bad) / counts
    # a step between two pure stretches of the same kind parts nothing
    at = np.flatnonzero((share[1:] != share[:-1]) | ((share[1:] > 0) & (share[1:] < 1)))
    if len(at) > most:
        upto = np.cumsum(counts)[at]
        at = at[np.unique(np.searchsorted(upto, np.linspace(upto[0], upto[-1], most)))]
    return [((values[i] + values[i + 1]) / 2, values[i + 1] - values[i]) for i in at.tolist()]


def likelihood_ratio(q: int, m: int, p: int, n: int) -> float:
    """How far ``q`` bad and ``m`` good rows are from a share of ``p`` bad to ``n`` good ones."""
    total, out = q + m, 0.0
    for seen, of in ((q, p), (m, n)):
        if seen:
            out += seen * math.log(seen * (p + n) / (total * of))
    return 2 * out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule | None:
    inside, chosen = np.ones(len(bad), bool), []
    while len(chosen) < most and (~bad & inside).any():
        own = bad[inside]
        p, n = int(own.sum()), int((~own).sum())
        best = ((1e-9, 0.0), None)
        for name in sorted(table):
            x = table[name][inside]
            spread = float(x.max() - x.min()) or 1.0
            for limit, gap in midpoints(x, own):
                for above in (True, False):
                    c = Condition(name, above, float(limit))
                    hit = c.holds(x)
                    q, m = int((hit & own).sum()), int((hit & ~own).sum())
                    if q < GROWN or likelihood_ratio(q, m, p, n) < CHANCE:
                        continue
                    gain = q * (math.log2((q + 1) / (q + m + 2)) - math.log2((p + 1) / (p + n + 2)))
                    # of equal gains the widest margin
                    if (gain, gap / spread) > best[0]:
                        best = ((gain, gap / spread), c)
        if best[1] is None:
            break
        chosen.append(best[1])
        inside &= best[1].holds(table[best[1].name])
    return Rule(tuple(chosen)) if chosen else None


def learn(table: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray, precision: float = 0.97, most: int = 12) -> list[Rule]:
    """The decision list of bad rows. ``turn`` (0, 1, 2) deals rows: 2 prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most:
        grow, prune = left & (turn != 2), left & (turn == 2)
        if (bad & grow).sum() < GROWN:
            break
        rule = _grow({k: v[grow] for k, v in table.items()}, bad[grow])
        if rule is None:
            break
        held, worth = {k: v[prune] for k, v in table.items()}, []
        for k in range(len(rule.conditions), 0, -1):
            hit = Rule(rule.conditions[:k]).holds(held)
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, -k, k))
        rule = Rule(rule.conditions[: max(worth)[3]])
        hit = rule.holds(table) & left
        caught, wrong = int((hit & bad).sum()), int((hit & ~bad).sum())
        if caught < SUPPORT or caught < precision * (caught + wrong):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_counts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Counts and label of at most ``sample`` labelled documents, by order of a hash of doc_id; of
    documents that share a doc_id one counts, by a hash of the text, so there is a row a doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_l_doc"), F.col("quality").alias("_l_quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_l_doc"))
    rows = rows.select(F.col("_l_doc").alias("doc_id"), F.col("_l_quality").alias("quality"), F.xxhash64("text").alias("h"), counts(F.col("text")).alias("c"))
    return rows.groupBy("doc_id", "quality").agg(F.min_by("c", "h").alias("c"))


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list of labelled documents (quality 0 is bad); no labels, no rules.

    Rows that fail the base rule are left out. Only statistics of the sample, at most ``sample``
    rows, reach the driver.
    """
    rows, values = labelled_counts(docs, labels, sample), ratios(F.col("c"))
    # as columns: a filter on the counts would be pushed below the join, onto every document
    got = rows.select(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)).alias("turn"), (F.col("quality") == 0).alias("bad"), base_failed(F.col("c")).alias("failed"), *[v.alias(k) for k, v in values.items()])
    got = got.orderBy("turn", *values).toPandas()
    got = got[~got["failed"]]
    if not len(got) or not got["bad"].any():
        return []
    return learn({k: got[k].to_numpy(float) for k in values}, got["bad"].to_numpy(bool), got["turn"].to_numpy(int))


def verdict(c: Column, rules: list[Rule]) -> Column:
    """The first rule that holds (from 1), 0 if none, -1 for the base rule: one conditional."""
    values, out = ratios(c), F.when(base_failed(c), F.lit(-1))
    for i, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for x in rule.conditions:
            condition = condition & x.expression(values)
        out = out.when(condition, F.lit(i))
    return out.otherwise(F.lit(0)).cast("int")


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``rule`` of every document.

    Null and empty texts have zeros and fail the base rule. One row per row, repeated rows too;
    an empty table gives an empty result; further columns are left out. No shuffle.
    """
    rows = docs.select("doc_id", counts(F.col("text")).alias("c"))
    rows = rows.select("doc_id", "c", verdict(F.col("c"), rules).alias("rule"))
    return rows.select("doc_id", *[F.col(f"c.{x}").alias(x) for x in COUNTS], base_failed(F.col("c")).alias("base_failed"), (F.col("rule") == 0).alias("kept"), "rule")


def drop_bad(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    Null and empty texts fail the base rule and go; repeated rows are judged alike and all stay or
    go; an empty table stays empty. No shuffle.
    """
    return docs.where(verdict(counts(F.col("text")), rules) == 0)
