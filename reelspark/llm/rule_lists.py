"""Quality rules: decision lists learnt by sequential covering.

Statistics of whole texts are computed once per document.  From a bounded sample of labelled statistics, rules for label
0 are grown condition by condition (by gain of information over thresholds at quantiles), pruned on rows kept aside, and
accepted while they stay precise there.  A list is ordered; its rules are plain threshold conjunctions, emitted as one
Spark conditional expression.

Defined results: a null text has no words and fails; an empty text likewise; null labels are ignored, labels that
disagree are averaged and rounded; without labels of both classes the list is empty and everything that passes the base
checks is kept; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.quality_model import fold, labelled_sample
from reelspark.llm.rows import map_slices, texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that rules may test; each is a double in the statistics table.
SHARES = (
    "mean_word symbol_share dup_line_share repeat_share upper_share digit_share mark_share distinct_share "
    "line_words stop_share bar_share"
).split()
WINDOW = 8
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    span = 1
    while span < window:  # ids of runs of 2, 4 and 8 words: equal ids, equal runs
        pairs = ids[: len(ids) - span] * (ids.max() + 1) + ids[span:]
        values, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        span *= 2
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_statistics(text: str) -> tuple:
    """COUNTS and SHARES of one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n, w = max(len(text), 1), max(len(words), 1)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    ascii_bytes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters = max(int(ascii_bytes[65:91].sum() + ascii_bytes[97:123].sum()), 1)
    return (
        len(words),
        word_chars,
        symbols,
        dup_lines,
        repeats,
        word_chars / w,
        symbols / w,
        dup_lines / max(len(lines), 1),
        repeats / w,
        int(ascii_bytes[65:91].sum()) / letters,
        int(ascii_bytes[48:58].sum()) / n,
        int(ascii_bytes[33]) / w,
        len(set(words)) / w,
        len(words) / max(len(lines), 1),
        int(ascii_bytes[46]) / w,
        int(ascii_bytes[124]) / w,
    )


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, COUNTS and SHARES of each document."""
    names = ["doc_id", *COUNTS, *SHARES]
    schema = ", ".join(f"{n} {'double' if n in SHARES else 'bigint'}" for n in names)

    def rows(batch: pa.RecordBatch) -> dict:
        found = [text_statistics(t) for t in texts(batch.column(1))]
        columns = list(zip(*found, strict=True)) if found else [()] * (len(names) - 1)
        return {"doc_id": batch.column(0)} | {n: list(c) for n, c in zip(names[1:], columns, strict=True)}

    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), schema, rows)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] < self.threshold

    def column(self) -> Column:
        return F.col(self.name) >= self.threshold if self.above else F.col(self.name) < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _matches(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Conditions added while they raise the share of bad rows, by the gain of first-order induction."""
    rule: Rule = ()
    rows = np.arange(len(bad))
    while len(rule) < most and 0 < bad[rows].sum() < len(rows):
        p0, best = bad[rows].mean(), (1e-9, None)
        for name in SHARES:
            values = table[name][rows]
            for cut in np.unique(np.quantile(values, np.linspace(0.01, 0.99, 49))):
                at_least = values >= cut
                for above, held in ((True, at_least), (False, ~at_least)):
                    k = bad[rows][held].sum()
                    if k:
                        gain = k * (np.log2(k / held.sum()) - np.log2(p0))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        # A tighter threshold on the same side takes the place of the looser one.
        rule = tuple(c for c in rule if (c.name, c.above) != (best[1].name, best[1].above)) + (best[1],)
        rows = rows[best[1].holds({best[1].name: table[best[1].name][rows]})]
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (bad - good) / (bad + good) on rows kept aside; ties: the shorter."""

    def worth(part: Rule) -> float:
        held = _matches(part, table, len(bad))
        return (2 * bad[held].sum() - held.sum()) / max(held.sum(), 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)))


def learn(
    table: dict[str, np.ndarray], good: np.ndarray, least_precision: float = 0.95, most_rules: int = 12, seed: int = 11
) -> list[Rule]:
    """Ordered rules for bad rows; every rule is precise on rows that did not grow it."""
    random = np.random.default_rng(seed)
    bad, rules = ~good, []
    alive = np.ones(len(bad), bool)
    while bad[alive].any() and len(rules) < most_rules:
        order = random.permutation(np.flatnonzero(alive))
        grow, keep = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
        rule = _grow({n: v[grow] for n, v in table.items()}, bad[grow], most=4)
        if not rule:
            break
        aside = {n: v[keep] for n, v in table.items()}
        rule = _prune(rule, aside, bad[keep])
        held = _matches(rule, aside, len(keep))
        if held.sum() < 5 or bad[keep][held].mean() < least_precision:
            break
        rules.append(rule)
        alive &= ~_matches(rule, table, len(bad))
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, else null: the list as one conditional expression."""
    found = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        held = F.lit(True)
        for condition in rules[number - 1]:
            held &= condition.column()
        found = F.when(held, F.lit(number)).otherwise(found)
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_from(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000) -> list[Rule]:
    """Rules of at most ``sample`` labelled documents outside fold 1 that pass the base checks."""
    chosen = labelled_sample(documents, labels, label, fold(F.col("doc_id")) != 1, sample)
    marks = chosen.select("doc_id", "label")
    measured = statistics(chosen).where(~base_failed()).join(marks, "doc_id").select(*SHARES, "label")
    rows = measured.toPandas()
    return learn({n: rows[n].to_numpy(float) for n in SHARES}, rows["label"].to_numpy() > 0)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (number of the first rule that holds) and kept of each document."""
    return (
        statistics(documents)
        .withColumns({"base_failed": base_failed(), "rule": first_rule(rules)})
        .select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
    )
