"""Quality rules learned as a decision list.

Sequential covering: while documents of the sought class remain, grow a conjunction of thresholds
on two thirds of the sample by information gain, prune it on the other third, and keep it if it is
precise on both. The result is an ordered list of readable rules that becomes one conditional
Spark expression, so applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import stored
from wattline.llm.statistics import document_statistics

#: Labelled documents that the learner looks at; the sample is drawn by a hash of the id.
SAMPLE_ROWS = 20_000
#: Thresholds tried per statistic, at quantiles of the sample.
CUTS = 48
#: A rule must be right for this share of the documents it covers, in both parts of the sample.
PRECISION = 0.98
#: Documents of the sought class that a rule must cover in the growing part.
LEAST_COVER = 5

RULE_STATISTICS = tuple(
    "symbol_share capital_share mark_share bare_share adjacent_share "
    "repeat_share dup_line_share variety mean_length n_words".split()
)


def rule_statistics() -> dict[str, Column]:
    """Ratios that rules may test; a text without words has the value 0."""

    def ratio(part: str, whole: str | Column) -> Column:
        whole = F.col(whole) if isinstance(whole, str) else whole
        return F.when(whole > 0, F.col(part) / whole).otherwise(0.0)

    return {
        "symbol_share": ratio("n_symbols", "word_chars"),
        "capital_share": ratio("n_capitals", F.col("n_capitals") + F.col("n_small")),
        "mark_share": ratio("n_marks", "word_chars"),
        "bare_share": ratio("n_bare", "n_words"),
        "adjacent_share": ratio("n_adjacent", "n_words"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        # The power of its number of words that the distinct ones make up: alike for short and long texts.
        "variety": F.log(F.col("n_distinct") + 1) / F.log(F.col("n_words") + 2),
        "mean_length": ratio("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    statistic: str
    above: bool
    cut: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.cut if self.above else x[self.statistic] <= self.cut

    def column(self) -> Column:
        return F.col(self.statistic) > self.cut if self.above else F.col(self.statistic) <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that meet all tests are of the sought class."""

    tests: tuple[Test, ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([test.mask(x) for test in self.tests])

    def column(self) -> Column:
        condition = self.tests[0].column()
        for test in self.tests[1:]:
            condition = condition & test.column()
        return condition

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _candidates(x: dict[str, np.ndarray], sought: np.ndarray) -> list[Test]:
    """Thresholds midway between neighbouring quantiles of all rows and of each class, in both directions."""
    tests, steps = [], np.linspace(0, 1, CUTS)
    for name, values in x.items():
        groups = [group for group in (values, values[sought], values[~sought]) if len(group)]
        marks = np.unique(np.concatenate([np.quantile(group, steps) for group in groups]))
        for cut in (marks[1:] + marks[:-1]) / 2:
            tests += [Test(name, True, float(cut)), Test(name, False, float(cut))]
    return tests


def _grow(x: dict[str, np.ndarray], sought: np.ndarray) -> Rule | None:
    """Add the test with the largest information gain until no other class is covered or none gains."""
    tests, covered = (), np.ones(len(sought), bool)
    while True:
        good, all_ = int((covered & sought).sum()), int(covered.sum())
        if good == 0 or good == all_:
            break
        before, best = np.log2(good / all_), (0.0, None)
        inside = {name: values[covered] for name, values in x.items()}
        right = sought[covered]
        for test in _candidates(inside, right):
            mask = test.mask(inside)
            hit, total = int((mask & right).sum()), int(mask.sum())
            if hit and (gain := hit * (np.log2(hit / total) - before)) > best[0] + 1e-9:
                best = (gain, test)
        if best[1] is None:
            break
        tests += (best[1],)
        covered &= best[1].mask(x)
    return Rule(tests) if tests else None


def _prune(rule: Rule, x: dict[str, np.ndarray], sought: np.ndarray) -> Rule:
    """The shortest beginning of the rule whose share of right minus wrong is best on unseen documents."""

    def worth(candidate: Rule) -> float | None:
        mask = candidate.mask(x)
        good, bad = int((mask & sought).sum()), int((mask & ~sought).sum())
        return (good - bad) / (good + bad) if good else None

    lengths = range(1, len(rule.tests) + 1)
    known = [(w, -n) for n in lengths if (w := worth(Rule(rule.tests[:n]))) is not None]
    return Rule(rule.tests[: -max(known)[1]]) if known else rule


def learn(x: dict[str, np.ndarray], sought: np.ndarray, *, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules for the class marked by ``sought``; rows are taken in the given order."""
    pruning = np.arange(len(sought)) % 3 == 2
    rules, left, banned = [], np.ones(len(sought), bool), set()

    def part(which: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {name: values[which] for name, values in x.items() if name not in banned}, sought[which]

    def precise(rule: Rule, which: np.ndarray, least: int) -> bool:
        mask = rule.mask(x) & which
        good, total = int((mask & sought).sum()), int(mask.sum())
        return good >= least and good >= precision * total

    while (left & sought).any():
        rule = _grow(*part(left & ~pruning))
        if rule is None:
            break
        shorter = _prune(rule, *part(left & pruning))
        for candidate in dict.fromkeys((shorter, rule)):
            if precise(candidate, left & ~pruning, LEAST_COVER) and precise(candidate, left & pruning, 0):
                rules.append(candidate)
                left &= ~candidate.mask(x)
                banned.clear()
                break
        else:  # no rule that begins with this statistic is precise: grow from the others
            banned.add(rule.tests[0].statistic)
    return rules


def expression(rules: list[Rule]) -> Column:
    """The decision list: 0-based number of the first rule that holds, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    chain = F.when(rules[0].column(), 0)
    for i, rule in enumerate(rules[1:], 1):
        chain = chain.when(rule.column(), i)
    return chain


def labelled_sample(statistics: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """About ``rows`` labelled documents (all, if fewer), chosen and ordered by a hash of the id."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = usable.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))
    total = known.count()
    share = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30))
    if total > rows:
        known = known.filter(share < int(rows / total * (1 << 30)))
    columns = rule_statistics()
    wanted = statistics.join(known, "id").select("label", share.alias("at"), *(columns[s].alias(s) for s in columns))
    sample = wanted.toPandas().sort_values(["at", *columns], kind="stable")
    return {name: sample[name].to_numpy(float) for name in columns}, sample["label"].to_numpy() == 0


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, base verdict, the deciding rule and the verdict for each row of ``docs``.

    Rules are learned from documents that ``labels`` marks with quality 0 or 1 (contradicting labels
    count as 0). Without such labels there are no rules and the base verdict decides. Null and empty
    texts have no words and fail the base rule.
    """
    statistics = stored(document_statistics(docs), "rule-statistics")
    rules = learn(*labelled_sample(statistics, labels))
    columns = rule_statistics()
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = statistics.select(
        F.col("id").alias("doc_id"),
        *("n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
        ((words < 20) | (100 * repeated > 30 * words)).alias("base_failed"),
        F.struct(*(column.alias(name) for name, column in columns.items())).alias("of"),
    )
    decided = base.withColumn("rule", base_rule(rules))
    return decided.select(
        "doc_id", *("n_words word_chars n_symbols n_dup_lines n_repeat_words".split()), "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
        "rule",
    )


def base_rule(rules: list[Rule]) -> Column:
    """The decision list over statistics held in the struct column ``of``."""
    inside = [Rule(tuple(Test(f"of.{t.statistic}", t.above, t.cut) for t in rule.tests)) for rule in rules]
    return expression(inside)
