"""Document statistics and a learned, readable list of rejecting rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.columns import beside, blank_words, grams, let, whole

GRAM, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Bounds of the sample that rules are learned from, and of a rule.
SAMPLE, CUTS, MAX_CONDITIONS, MAX_RULES, PRECISION = 8_000, 24, 3, 12, 0.97
STATISTICS = ("symbol_share", "upper_share", "repeat_share", "dup_line_share", "mark_share", "digit_share", "word_length", "n_words")


def repeated_words(words: Column) -> Column:
    """Words inside windows of `GRAM` words that occur at least twice. Most texts have none, which a hash set tells; only the others sort
    their windows, mark equal neighbours and add up the stretches that the marked windows cover."""

    def from_sorted(pairs: Column) -> Column:
        equal = F.filter(pairs, lambda e, i: (F.get(pairs, i - 1)["x"] == e["x"]) | (F.get(pairs, i + 1)["x"] == e["x"]))
        starts = F.sort_array(F.transform(equal, lambda e: e["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get(s, i + 1), p + GRAM) - p)), F.lit(0), lambda a, x: a + x))

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, from_sorted))

    return let(grams(words, GRAM, lambda s: F.xxhash64(s)), from_hashes)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the shares that rules test."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    measures = let(blank_words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    dup = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    out = docs.withColumns({
        "_m": measures, "n_symbols": count("[#*$%&|<>]"), "n_dup_lines": dup.cast("long"), "_upper": count("[A-Z]+[!?.,;:]*"),
        "_marks": count("[!?;:]+"), "_digits": count("[0-9]+"), "_line_count": F.size(F.split(text, "\n")),
    })
    out = out.select(*(f"`{c}`" for c in docs.columns), "_m.*", "n_symbols", "n_dup_lines", "_upper", "_marks", "_digits", "_line_count")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")),
        "symbol_share": per_word("n_symbols"), "upper_share": per_word("_upper"), "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_line_count"), F.lit(1)), "mark_share": per_word("_marks"),
        "digit_share": per_word("_digits"), "word_length": per_word("word_chars"),
    }).drop("_upper", "_marks", "_digits", "_line_count")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[Condition, ...]]:
    """An ordered list of conjunctions that pick bad rows, by sequential covering on numbers of a bounded sample.

    Two thirds of the rows grow a rule, condition by condition, by the information gained; the others prune trailing conditions and must
    confirm it. A rule stays if `PRECISION` of the rows it picks are bad on both parts; what it covers leaves the sample before the next.
    """
    rules: list[tuple[Condition, ...]] = []
    if bad.sum() < 5 or (~bad).sum() < 5:
        return rules
    cuts = {n: np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[:-1])) for n, v in x.items()}
    for name in cuts:  # the gap between the classes matters more than the bulk
        cuts[name] = np.unique(np.r_[cuts[name], np.quantile(x[name][bad], np.linspace(0, 1, CUTS + 1)), np.quantile(x[name][~bad], [0.9, 0.99, 0.999, 1])])
    part = np.arange(len(bad)) % 3 == 2
    alive = np.ones(len(bad), bool)
    precision = lambda at: bad[at].mean() if at.any() else 0.0
    while len(rules) < MAX_RULES:
        rule, at = [], alive & ~part
        if bad[at].sum() < 3:
            break
        while len(rule) < MAX_CONDITIONS and precision(at) < 1:
            base, best = np.log2(max(precision(at), 1e-9)), (0.0, None, None)
            for name, edges in cuts.items():
                for cut in edges:
                    for above in (True, False):
                        c = Condition(name, above, float(cut))
                        now = at & c.holds(x)
                        p = bad[now].sum()
                        if p >= 3 and (gain := p * (np.log2(p / now.sum()) - base)) > best[0] + 1e-9:
                            best = (gain, c, now)
            if best[1] is None:
                break
            rule.append(best[1])
            at = best[2]

        def picks(conditions, rows):
            return rows & np.logical_and.reduce([c.holds(x) for c in conditions])

        if not rule:
            break
        while len(rule) > 1:
            full, short = picks(rule, alive & part), picks(rule[:-1], alive & part)
            if precision(short) < precision(full) or not short.any():
                break
            rule.pop()
        grown, held = picks(rule, alive & ~part), picks(rule, alive & part)
        if precision(grown) < PRECISION or (held.any() and precision(held) < PRECISION):
            break
        rules.append(tuple(rule))
        alive &= ~picks(rule, alive)
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[Condition, ...]]:
    """Rules from at most `sample` labelled documents, those with the smallest hash of their id. Base failures are left out: they need no rule."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = statistics(rows.select("doc_id", "text", "quality")).where(~F.col("base_failed"))
    got = sorted(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select("doc_id", "quality", *STATISTICS).collect())
    if not got:
        return []
    x = {n: np.array([r[n] for r in got], float) for n in STATISTICS}
    return learn(x, np.array([r["quality"] == 0 for r in got]))


JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(s for s in STATISTICS if s != "n_words"), "rule", "kept")


@beside(("text",), JUDGED)
def judge(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """Adds the statistics, `rule` (number of the first rule that rejects, 0 for the base rule, else missing) and `kept`.

    A missing or empty text has no words and fails the base rule. Each row is judged alone, so repeated rows agree; other columns
    stay, but those named like an added one are replaced. An empty table gives an empty result.
    """
    verdict = F.when(F.col("base_failed"), F.lit(0))
    for number, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        verdict = verdict.when(test, F.lit(number))
    return statistics(docs).withColumn("rule", verdict).withColumn("kept", F.col("rule").isNull())


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), learn_rules(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
