"""Quality rules: a decision list learned by sequential covering.

A NumPy kernel takes a fixed set of statistics of each text.  On a bounded
sample of labelled rows the learner covers the low-quality class rule by rule:
it grows a conjunction of thresholds by FOIL gain on one part of the sample,
prunes its last conditions on the other, keeps it if it is precise there, drops
the rows it covers and goes on (IREP).  The list becomes one ordered
``CASE WHEN`` over the statistics, which Spark evaluates row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Labelled rows to learn from at most (the first by a hash of their id).
MAX_LABELLED = 20_000
#: A rule must be this precise, on the rows that judge and on all, and cover so many bad rows.
MIN_PRECISION, MIN_COVER = 0.9, 3
#: Size of the model: conditions of a rule and rules of a list at most; no row is left out by it.
MAX_CONDITIONS, MAX_RULES = 4, 24

STATS = ("n_bytes", "n_words", "word_len", "upper", "symbol", "digit", "bang", "pipe", "stop", "distinct_words", "repeated_5grams", "repeated_lines", "line_words", "symbol_words")

_byte = np.arange(256)
_UPPER = ((_byte >= 65) & (_byte < 91)).astype(np.uint8)
_LETTER = (((_byte | 32) >= 97) & ((_byte | 32) < 123) & (_byte < 128) | (_byte >= 0xC0)).astype(np.uint8)
_SYMBOL = np.isin(_byte, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]).astype(np.uint8)
_DIGIT = ((_byte >= 48) & (_byte < 58)).astype(np.uint8)
_STOP = np.isin(_byte, [ord(c) for c in ".?!"]).astype(np.uint8)


def _repeated(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Share of entries of each doc that equal another entry of it before them."""
    total = np.bincount(doc, minlength=docs).astype(float)
    if not len(h):
        return np.zeros(docs)
    at = K.first_of_each(h, doc)
    return 1 - np.bincount(doc[at], minlength=docs) / np.maximum(total, 1) * (total > 0) - (total == 0)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of :data:`STATS` for each text; a text without words has zeros."""
    out = []
    for part in K.slices(pa.record_batch([column], ["text"])):
        data, offsets = K.buffers(part.column("text"))
        docs = part.num_rows
        start, end, first = K.word_spans(data, offsets, K.NONSPACE)
        h = K.word_hashes(data, start, end)
        words = np.diff(first).astype(float)
        doc = np.repeat(np.arange(docs), np.diff(first))
        size = np.diff(offsets).astype(float)
        byte = np.maximum(size, 1)
        word = np.maximum(words, 1)
        letters = np.maximum(K.segment_sums(_LETTER[data], offsets), 1)
        line = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=line[1:])
        lines = np.maximum(line[offsets[1:]] - line[offsets[:-1]] + 1, 1)
        grams = K.window_hashes(h, 5)
        inside = doc[: len(grams)] == doc[len(h) - len(grams) :] if len(grams) else np.zeros(0, bool)
        # a line is the words that follow one line end before the next; its hash is that of its words
        of = line[start] + doc
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        lh = K.range_hashes(h, new, np.r_[new[1:], len(h)]) if len(new) else np.zeros(0, np.uint64)
        symbol = _SYMBOL[data]
        sword = np.zeros(len(data) + 1, np.int32)
        np.cumsum(symbol, out=sword[1:])
        columns = (
            size, words, (K.segment_sums(end - start, first)) / word, K.segment_sums(_UPPER[data], offsets) / letters, K.segment_sums(symbol, offsets) / byte,
            K.segment_sums(_DIGIT[data], offsets) / byte, K.segment_sums((data == 33).view(np.uint8), offsets) / word, K.segment_sums((data == 124).view(np.uint8), offsets) / word,
            K.segment_sums(_STOP[data], offsets) / word, 1 - _repeated(h, doc, docs), _repeated(grams[inside], doc[: len(grams)][inside], docs),
            _repeated(lh, doc[new], docs), words / lines, K.segment_sums((sword[end] > sword[start]).view(np.uint8), first) / word,
        )
        out.append(np.stack(columns, 1) * (words > 0)[:, None])
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def stats_column(text: str) -> Column:
    """Struct of :data:`STATS` (doubles); null text counts as empty."""

    @F.arrow_udf("struct<" + ",".join(f"{s}:double" for s in STATS) + ">")
    def run(column: pa.Array) -> pa.Array:
        table = statistics(column)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATS))], list(STATS))

    return run(F.col(text))


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    bound: float

    def column(self, stats: str) -> Column:
        c = F.col(f"{stats}.{self.stat}")
        return c >= F.lit(self.bound) if self.at_least else c <= F.lit(self.bound)

    def holds(self, x: np.ndarray) -> np.ndarray:
        c = x[:, STATS.index(self.stat)]
        return c >= self.bound if self.at_least else c <= self.bound

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition of the largest FOIL gain over rows that a rule covers so far."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), None
    for k, stat in enumerate(STATS):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        edge = np.flatnonzero(v[1:] != v[:-1])
        if not len(edge):
            continue
        p, n = np.cumsum(b)[edge], np.cumsum(~b)[edge]
        for at_least, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-12):
                best = (float(gain[at]), Condition(stat, at_least, float((v[edge[at]] + v[edge[at] + 1]) / 2)))
    return best


def grow(x: np.ndarray, bad: np.ndarray, max_conditions: int = MAX_CONDITIONS) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions and (found := _best(x, bad)):
        rule += (found[1],)
        inside = found[1].holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The start of ``rule`` with the largest (p - n) / (p + n), the shortest of equals."""

    def worth(size: int) -> float:
        c = covers(rule[:size], x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, max_conditions: int = MAX_CONDITIONS, max_rules: int = MAX_RULES) -> list[Rule]:
    """Ordered rules for the rows in ``bad``; every third row prunes and judges, the others grow."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2
    x, bad, part = x.astype(np.float64), bad.astype(bool), part
    while len(rules) < max_rules and (bad & ~part).sum() >= min_cover and (~bad).any():
        rule = prune(grow(x[~part], bad[~part], max_conditions), x[part], bad[part])
        if not rule:
            break
        c = covers(rule, x)
        p, n = (c & bad & part).sum(), (c & ~bad & part).sum()
        whole_p, whole_n = (c & bad).sum(), (c & ~bad).sum()
        if whole_p < min_cover or (p + n and p / (p + n) < min_precision) or whole_p / (whole_p + whole_n) < min_precision:
            break
        rules.append(rule)
        x, bad, part = x[~c], bad[~c], part[~c]
    return rules


def rules_column(rules: list[Rule], stats: str) -> Column:
    """Number from 1 of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        condition = F.lit(True)
        for c in rules[k - 1]:
            condition = condition & c.column(stats)
        out = F.when(condition, F.lit(k)).otherwise(out)
    return out


def learned_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, **bounds) -> list[Rule]:
    """Rules from at most ``max_labelled`` rows of ``labels`` (label 0 is bad); none if a class is absent.

    A null id, label or text isn't used; repeated rows count as often as they
    occur.  ``bounds`` are those of :func:`learn`.
    """
    sample = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null").orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_labelled)
    met = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    got = met.select("_id", "_label", stats_column("_text").alias("_s"), F.xxhash64("_text").alias("_hash")).select("_id", "_label", "_hash", "_s.*").toArrow()
    order = np.lexsort([got.column(c).to_numpy() for c in ("_label", "_hash", "_id")])
    mixed = np.argsort(K.mix(got.column("_id").to_numpy()[order].astype(np.int64).view(np.uint64)), kind="stable")
    order = order[mixed]
    x = np.stack([got.column(s).to_numpy() for s in STATS], 1)[order] if got.num_rows else np.zeros((0, len(STATS)))
    return learn(x, got.column("_label").to_numpy()[order] == 0 if got.num_rows else np.zeros(0, bool), **bounds)


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, rule, reason, keep) for every row of ``docs``.

    ``rule`` is the first rule that holds (0: none) and ``reason`` its text.  Null
    and empty texts and texts without words get rule -1 and are not kept.  With
    no labelled rows, or one class only, every other row is kept.  Ids may repeat
    or be null; other columns are ignored.
    """
    rules = learned_rules(docs, labels, doc_id=doc_id, text=text, **options)
    number = F.when(F.col("_s.n_words") > 0, rules_column(rules, "_s")).otherwise(-1)
    reason = F.when(F.col("rule") == -1, "no words")
    for k, r in enumerate(rules, 1):
        reason = reason.when(F.col("rule") == k, " and ".join(map(str, r)))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), stats_column(text).alias("_s"))
    return rows.select("doc_id", number.alias("rule")).select("doc_id", "rule", reason.alias("reason"), (F.col("rule") == 0).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged.

    Null and empty texts and texts without words go, whatever the rules; repeated
    rows stay or go together, and ids may repeat or be null.
    """
    rules = learned_rules(docs, labels, doc_id=doc_id, text=text, **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), stats_column(text).alias("_s"))
    return rows.where((F.col("_s.n_words") > 0) & (rules_column(rules, "_s") == 0)).select("_row.*")
