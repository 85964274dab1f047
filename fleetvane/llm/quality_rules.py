"""Operator 8: quality rules as a short-circuit cascade.

A document is kept if it passes every rule. Each rule's cost and the share of documents that it rejects are estimated on
a sample; the rules then run in descending order of rejections per cost, and a document leaves at its first failure. The
order changes the work only, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetvane.llm.common import WORD, by_slices, give_back, texts_of

_words, _symbols = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall
#: Documents of the sample on which costs and selectivities are estimated; it decides on the order of rules only.
SAMPLE = 200


class DocStats:
    """Counts of a text, each made when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return _words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_symbols(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\r\v\f")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        numbers: dict[str, int] = {}
        w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in self.words), np.int64, n)
        pairs = np.unique(w[:-1] * len(numbers) + w[1:], return_inverse=True)[1]
        _, window, counts = np.unique(pairs[:-1] * len(numbers) + w[2:], return_inverse=True, return_counts=True)
        twice = counts[window] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        return int(hit.sum())

    @cached_property
    def n_upper_words(self) -> int:
        return sum(len(x) > 1 and x.isupper() for x in self.words)


Rule = Callable[[DocStats], bool]
#: True: passes. The first two are the base rules.
RULES: dict[str, Rule] = {
    "enough_words": lambda d: d.n_words >= 50,
    "few_repeated_words": lambda d: 100 * d.n_repeat_words <= 50 * d.n_words,
    "few_symbols": lambda d: 4 * d.n_symbols <= d.n_words,
    "usual_word_length": lambda d: 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "few_repeated_lines": lambda d: 2 * d.n_dup_lines <= len(d.lines),
    "little_shouting": lambda d: 100 * d.n_upper_words <= 30 * d.n_words,
}
BASE = ("enough_words", "few_repeated_words")


def order_rules(texts: list[str], rules: dict[str, Rule] | None = None) -> list[str]:
    """The rules' names by estimated rejections per second, highest first; ties keep their given order. Each rule is timed on fresh counts."""
    rules = rules or RULES
    rate = {}
    for name, rule in rules.items():
        began, rejected = time.perf_counter(), sum(not rule(DocStats(t)) for t in texts)
        rate[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda name: -rate[name])


def estimated_order(docs: DataFrame, rules: dict[str, Rule] | None = None) -> list[str]:
    """The order on a random sample of all of docs, in expectation SAMPLE of them; a sorted table is sampled as evenly as any other."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    return order_rules([r.text or "" for r in docs.select("text").sample(share, seed=7).limit(4 * SAMPLE).toLocalIterator()], rules)


def passes(stats: DocStats, order: list[str], rules: dict[str, Rule] | None = None) -> bool:
    rules = rules or RULES
    return all(rules[name](stats) for name in order)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text passes every rule; rules after the first that rejects are not run.

    A null text has no words and goes. Repeated rows and null ids are judged each on their own, extra columns stay, and an empty table gives no rows.
    """
    order = order or estimated_order(docs)

    def make():
        give_back()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([passes(DocStats(t), order) for t in texts_of(batch, "text")], pa.bool_()))

        return each

    return docs.mapInArrow(by_slices(512, make), docs.schema)


def quality_verdicts(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document.

    A null text counts as empty: no words, base_failed. Repeated and null doc_ids keep one row each.
    """
    order = order or estimated_order(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            stats = [DocStats(t) for t in texts_of(batch, "text")]
            kept = [passes(s, order) for s in stats]
            failed = [not passes(s, BASE) for s in stats]
            counts = [pa.array([getattr(s, n) for s in stats], pa.int64()) for n in names]
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed, pa.bool_()), pa.array([k and not f for k, f in zip(kept, failed, strict=True)], pa.bool_())], ["doc_id", *names, "base_failed", "kept"])

        return each

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(by_slices(128, make), "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


#: The same in SQL: \n-split lines, words by white space, three-word windows by position.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS raw_lines FROM d),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM s),
win AS (SELECT doc_id, pos, word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM w),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL),
hits AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(raw_lines) AS line FROM s) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
st AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, CAST(coalesce(hits.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper
  FROM s LEFT JOIN dup USING (doc_id) LEFT JOIN hits USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 4 * n_symbols <= n_words AND 2 * n_words <= word_chars AND word_chars <= 15 * n_words
  AND 2 * n_dup_lines <= n_lines AND 100 * n_upper <= 30 * n_words AS kept
FROM st
"""
