"""Quality rules: a decision list, learned from labelled documents, that runs as one Spark conditional expression.

Counts of a text (words, symbols, repeated lines, repeated eight-word windows, repeated neighbours) are Spark expressions
over the whole text. Learning is sequential covering: a rule starts empty and grows by the threshold condition
with the best FOIL gain on two thirds of the labelled rows, is pruned on the other third, and takes the rows it covers away;
the next rule learns from the rest. Each step needs only counts by (feature, bin, label), which one aggregation
gives, so what reaches the driver has a fixed size. The list becomes nested ``when`` expressions in order of learning.

Defined cases: a null or empty text has no words and fails the base rule; a null label row is left out of
learning, as are labels without a document; rows that repeat count each time; with no labelled row of either class the
list is empty, and only the base rule rejects; other columns are carried along, but for those named like an added one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import settle, without, words

#: Fixed values of the contract: symbols, window length, base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_same_next")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts, n_lines (lines with a word) and n_same_next (words equal to the word before), all long.

    Windows are compared by 64-bit hashes within one text.
    """
    docs = without(docs, COUNTS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.expr(r"transform(filter(_q_lines, x -> x rlike '[^ \\x09-\\x0D]'), x -> xxhash64(x))")
    step = docs.withColumns({"_q_words": words(text), "_q_lines": F.split(text, "\n", -1)})
    step = step.withColumns({"_q_hash": F.expr("transform(_q_words, w -> xxhash64(w))"), "_q_lines": lines})
    windows = f"if(size(_q_hash) < {WINDOW}, array(), transform(sequence(0, size(_q_hash) - {WINDOW}), i -> xxhash64(slice(_q_hash, i + 1, {WINDOW}))))"
    step = step.withColumn("_q_windows", F.expr(f"cast({windows} as array<bigint>)"))
    # Only a text with a repeated window pays for sorting; equal neighbours in hash order are the repeated ones.
    step = step.withColumn(
        "_q_sorted",
        F.expr("if(size(array_distinct(_q_windows)) < size(_q_windows), sort_array(transform(_q_windows, (h, i) -> struct(h as h, i as i))), cast(array() as array<struct<h:bigint,i:int>>))"),
    )
    again = "filter(_q_sorted, (x, k) -> (k > 0 and _q_sorted[greatest(k, 1) - 1].h = x.h) or (k < size(_q_sorted) - 1 and _q_sorted[least(k + 1, size(_q_sorted) - 1)].h = x.h))"
    step = step.withColumn("_q_starts", F.expr(f"sort_array(transform({again}, x -> x.i))"))
    covered = f"aggregate(transform(_q_starts, (s, k) -> if(k = size(_q_starts) - 1, {WINDOW}, least({WINDOW}, _q_starts[least(k + 1, size(_q_starts) - 1)] - s))), 0L, (a, b) -> a + b)"
    same = "size(filter(transform(_q_hash, (h, i) -> i > 0 and _q_hash[greatest(i, 1) - 1] = h), x -> x))"
    counts = {
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]", "")).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.expr(covered).cast("long"),
        "n_same_next": F.expr(same).cast("long"),
    }
    # As one generated row, for a filter on the counts must not be pushed into the expressions and repeat them.
    return step.select(*docs.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in counts.items()]))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Shares that do not depend on how long a text is, and its length."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "same_next": share("n_same_next", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet every condition are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        met = F.lit(True)
        for condition in self.conditions:
            met = met & condition.column()
        return met

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def fired(self) -> Column:
        """The position of the first rule that fires, null if none does."""
        found = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            found = F.when(rule.column(), F.lit(k)).otherwise(found)
        return found

    def keeps(self) -> Column:
        return self.fired().isNull()


@dataclass(frozen=True)
class Settings:
    bins: int = 24
    #: Growing ends where no condition gains or none is wrongly covered, the list where no rule is good enough: a rule must be right on this share of what it covers, and cover this many rows of the growing part.
    min_precision: float = 0.9
    min_cover: int = 3


def labelled_counts(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Counts, label and fold of the documents to learn from, written to shared storage."""
    return _labelled(text_counts(docs.select(id_col, "text")), labels, id_col, label_col)


def _labelled(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``labelled_counts`` of documents that have their counts: these meet the labels, whose number grows with the documents', and no text does."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_q_id"), F.col(label_col).alias("_q_label"))
    own = counted.select(F.col(id_col).alias("_q_doc"), *COUNTS).where(~base_failed())
    kept = own.join(known, F.col("_q_doc") == F.col("_q_id"))
    fold = F.pmod(F.xxhash64(F.lit(1), "_q_id"), F.lit(3))
    return settle(kept.withColumns({"bad": (F.col("_q_label") == 0).cast("int"), "prune": fold == 0}).select(*COUNTS, "bad", "prune"), "labelled")


class _Learner:
    def __init__(self, rows: DataFrame, settings: Settings) -> None:
        self.settings, names = settings, list(features())
        probs = [k / settings.bins for k in range(settings.bins + 1)]
        found = rows.withColumns(features()).agg(
            *[F.percentile_approx(c, probs, 10_000).alias(f"all_{c}") for c in names],
            *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(c)), probs, 10_000).alias(f"bad_{c}") for c in names],
        ).first()
        # Thresholds lie halfway between neighbouring quantiles, so a gap between the classes is split in its middle.
        seen = {c: sorted({float(x) for side in ("all", "bad") for x in (found[f"{side}_{c}"] or [])}) for c in names}
        self.cuts = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in seen.items()}
        bin_of = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in self.cuts[c]]), lambda x: F.col(c) > x)) if self.cuts[c] else F.lit(0)
        binned = rows.withColumns(features()).select("bad", "prune", *[bin_of(c).alias(c) for c in names])
        # Rows that fall into the same bins are alike to every candidate: keep one with its count.
        self.rows = settle(binned.groupBy("bad", "prune", *names).agg(F.count(F.lit(1)).alias("n")), "binned")

    def met(self, conditions) -> Column:
        """A condition on bins: bin b holds values above exactly b cuts."""
        found = F.lit(True)
        for c in conditions:
            k = self.cuts[c.feature].index(c.threshold)
            found = found & (F.col(c.feature) > k if c.above else F.col(c.feature) <= k)
        return found

    def counts(self, rest: Column, prune: bool) -> dict[tuple[str, int], list[int]]:
        """(feature, bin) -> [good, bad] of the rows left."""
        names = list(self.cuts)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in names])).alias("at")
        got = self.rows.where(rest & (F.col("prune") == prune)).select("bad", "n", pairs).groupBy("at.feature", "at.bin", "bad").agg(F.sum("n").alias("n")).collect()
        found: dict[tuple[str, int], list[int]] = {}
        for r in got:
            found.setdefault((r["feature"], r["bin"]), [0, 0])[r["bad"]] += r["n"]
        return found

    def totals(self, rest: Column, prune: bool, prefixes: list[Column]) -> list[tuple[int, int]]:
        aggs = [F.sum(F.when(p & (F.col("bad") == b), F.col("n")).otherwise(0)) for p in prefixes for b in (0, 1)]
        got = self.rows.where(rest & (F.col("prune") == prune)).agg(*aggs).first()
        return [(int(got[2 * k] or 0), int(got[2 * k + 1] or 0)) for k in range(len(prefixes))]

    def best(self, conditions: list[Condition], rest: Column) -> tuple[Condition | None, int, int]:
        counts = self.counts(rest & self.met(conditions), prune=False)
        first = next(iter(self.cuts))
        good, bad = (sum(v[k] for (c, _), v in counts.items() if c == first) for k in (0, 1))
        if not bad:
            return None, good, bad
        before, top = math.log2(bad / (good + bad)), (0.0, None, good, bad)
        for c, cuts in self.cuts.items():
            low_good = low_bad = 0
            for k, cut in enumerate(cuts):
                g, b = counts.get((c, k), (0, 0))
                low_good, low_bad = low_good + g, low_bad + b
                for above, g1, b1 in ((True, good - low_good, bad - low_bad), (False, low_good, low_bad)):
                    if b1 >= self.settings.min_cover and (gain := b1 * (math.log2(b1 / (g1 + b1)) - before)) > top[0] + 1e-9:
                        top = (gain, Condition(c, above, cut), g1, b1)
        return top[1:]

    def grow(self, rest: Column) -> Rule | None:
        conditions: list[Condition] = []
        good = bad = 0
        while True:
            found, g, b = self.best(conditions, rest)
            if found is None:
                break
            conditions.append(found)
            good, bad = g, b
            if not good:
                break
        if not conditions:
            return None
        # Prune: the prefix with the best margin on rows that growing did not see; a tie goes to the shorter one.
        ends = range(1, len(conditions) + 1)
        seen = self.totals(rest, True, [self.met(conditions[:k]) for k in ends])
        worth = [(b - g) / (b + g) if b + g else -1.0 for g, b in seen]
        if max(worth) > -1.0:
            conditions = conditions[: worth.index(max(worth)) + 1]
        (g, b), = self.totals(rest, False, [self.met(conditions)])
        pg, pb = seen[len(conditions) - 1]
        right = (b + pb) / max(1, g + b + pg + pb)
        return Rule(tuple(conditions)) if b >= self.settings.min_cover and right >= self.settings.min_precision else None


def learn(rows: DataFrame, settings: Settings = Settings()) -> DecisionList:
    """A decision list from the rows of ``labelled_counts``."""
    seen = rows.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not seen["bad"] or seen["bad"] == seen["n"]:
        return DecisionList()
    learner, rules, rest = _Learner(rows, settings), [], F.lit(True)
    # Each rule takes min_cover rows away at least, so this ends.
    while rule := learner.grow(rest):
        rules.append(rule)
        rest = rest & ~learner.met(rule.conditions)
    return DecisionList(tuple(rules))


def _judged(counted: DataFrame, rules: DecisionList) -> DataFrame:
    return counted.withColumns({"base_failed": base_failed(), "rule": rules.fired()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds the counts, base_failed, rule (the one that rejects, from 0) and kept."""
    return _judged(text_counts(docs), rules)


def learn_and_judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), with_text: bool = True) -> DataFrame:
    """``judge`` by the rules learned from all labelled rows. Without the text, it is read and counted once; else once more to judge."""
    counted = text_counts(docs)
    if not with_text:
        counted = settle(counted.drop("text"), "counted")
    return _judged(counted, learn(_labelled(counted, labels), settings))
