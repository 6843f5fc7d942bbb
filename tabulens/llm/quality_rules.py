"""Quality rules as a short-circuit cascade.

Every rule looks at facts of one text. A fact is measured when a rule first asks for it, and the first rule that rejects
a text ends its evaluation. On a bounded random sample each rule is timed and its rejections are counted; rules then run
by rejections per second, so that cheap rules that reject much spare the dear ones. The order never changes a verdict,
only its cost.

Edge cases: a null text counts as an empty one and has no word, so the first base rule rejects it. Repeated rows and
equal ids are judged alike, each row for itself. An empty table gives no rows and the rules keep their stated order.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import SPACES, col, small_batches, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5


class Facts:
    """Counts of one text, each taken once and only when asked for."""

    def __init__(self, text: str | None):
        self.raw = utf8(text)
        self.code_points = len(text or "")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.code_points - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @property
    def n_text_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of five words that occur at least twice in the text."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered = reach = 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered += i + WINDOW - max(i, reach)
                reach = i + WINDOW
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


# The first two are the base rules; the others follow published web-text filters.
RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 30 * f.n_text_lines),
    Rule("word_length", lambda f: f.word_chars < 3 * f.n_words or f.word_chars > 12 * f.n_words),
)
BASE = ("few_words", "repeated_words")
_FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 1000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second, as measured on about ``sample_rows`` random rows (ties: stated order).

    The expected size of the sample is the only bound; one row per rule and task comes back from it.
    """
    small_batches(docs.sparkSession)
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for i, rule in enumerate(rules):
                    facts = Facts(value)
                    start = time.perf_counter()
                    hits[i] += rule.rejects(facts)
                    spent[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "spent": spent, "hits": hits})

    sample = docs.select(col(text).cast("string").alias("text")).sample(min(1.0, sample_rows / total), seed)
    found = sample.mapInArrow(measure, "rule long, spent double, hits long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()
    worth = {r["rule"]: r["hits"] / max(r["spent"], 1e-9) for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth.get(i, 0.0), i))]


def verdict(text: Column, order: Sequence[Rule] = RULES) -> Column:
    """The name of the first rule in ``order`` that rejects the text, or null."""

    @pandas_udf("string")
    def first_rejection(texts: pd.Series) -> pd.Series:
        def judge(value: str | None) -> str | None:
            facts = Facts(value)
            return next((rule.name for rule in order if rule.rejects(facts)), None)

        return pd.Series([judge(t) for t in texts], dtype=object)

    return first_rejection(text)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with their columns as they were."""
    return docs.where(verdict(col(text).cast("string"), plan_cascade(docs, rules, text, sample_rows)).isNull())


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Facts and verdict of every row; ``rejected_by`` is the first rule in stated order that rejects it.

    The verdict comes from the cascade; the facts it did not need are measured afterwards, as the report shows all.
    """
    order = plan_cascade(docs, rules, text, sample_rows)
    stated = [rule.name for rule in rules]

    @pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            facts = Facts(value)
            kept = not any(rule.rejects(facts) for rule in order)
            by = None if kept else next(n for n in stated if next(r for r in rules if r.name == n).rejects(facts))
            rows.append((*(getattr(facts, name) for name in _FACTS), by in BASE, kept, by))
        return pd.DataFrame(rows, columns=[*_FACTS, "base_failed", "kept", "rejected_by"])

    return docs.select(col(doc_id).alias("doc_id"), judge(col(text).cast("string")).alias("__facts")).select("doc_id", "__facts.*")
