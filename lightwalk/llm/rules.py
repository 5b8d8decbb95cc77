"""Quality rules as a short-circuit cascade: rules are ordered by rejections per cost, and a text leaves at its first failure.

A rule rejects a text by a few measures (words, symbols, repeated lines, ...). A measure is computed from the text or from
other measures, once per text, when a rule first asks for it. ``Cascade.planned`` measures a bounded sample: the time of
every measure, and which rules reject which texts. It then orders the rules greedily: next comes the rule with most
rejections among the sampled texts still alive, per nanosecond that it adds (measures that earlier rules have asked for are
free). ``judge`` runs the cascade over all rows in that order.

The order changes only the work: a text is kept if no rule rejects it, which no order alters. ``failed`` and ``n_rules``
(the rule that rejected first, and how many were asked) do depend on the order, hence on the clock.

The sample is the first ``sample_rows`` rows that Spark finds in a share of the table, so that planning reads a few
partitions, not the table; its result is that many short rows of times and flags. On an empty table the rules keep the
order in which they were given.

Cases: null and empty texts, and those without words, have zeros and fail the base rule; very long texts are measured as a
whole, with memory in proportion to their own length; repeated rows are judged each for itself; an empty table gives an
empty result; further columns pass through ``judge``, whose own column names are parameters.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from . import common

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_TRAILING = re.compile(rf"(?:\.\.\.|…)[{SPACES}]*\Z")
_BULLET = re.compile(rf"[{SPACES}]*[-*•]")
#: Bytes by what is left of a text without the others.
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in SPACES)
_NO_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NO_SMALL = bytes(c for c in range(256) if not 97 <= c <= 122)


@dataclass(frozen=True)
class Measure:
    """A value of a text, from the measures that ``needs`` names ("text": the text itself)."""

    name: str
    needs: tuple[str, ...]
    of: Callable


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures that ``needs`` names."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words as numbers, and the word of each number."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), list(known)


def repeated_words(numbers: tuple[np.ndarray, list[bytes]], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are told apart exactly. Where the vocabulary is small a window is one number in its base; else neighbouring
    numbers are paired and numbered anew until a number stands for a whole window.
    """
    single, base = numbers[0], len(numbers[1])
    count = len(single) - width + 1
    if count < 2 or base == len(single):
        return 0
    if base**width < 1 << 63:
        rank = np.zeros(count, np.int64)
        for k in range(width):
            rank = rank * base + single[k : k + count]
    else:
        rank, covered = single, 1
        while covered < width:
            step = min(covered, width - covered)  # the windows at k and at k + step together cover covered + step words
            _, rank = np.unique(rank[: len(rank) - step] * len(single) + rank[step:], return_inverse=True)
            covered += step
    order = np.sort(rank)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(rank, again))
    edges = np.bincount(places, minlength=len(single) + 1) - np.bincount(places + width, minlength=len(single) + 1)
    return int((np.cumsum(edges) > 0).sum())


def top_pair(numbers: tuple[np.ndarray, list[bytes]]) -> int:
    """Code points of the pair of neighbouring words that covers most, among the pairs that occur more than once."""
    single, known = numbers
    order = np.sort(single[:-1] * max(1, len(known)) + single[1:])
    pairs, n = np.unique(order[np.isin(order, order[1:][order[1:] == order[:-1]])], return_counts=True)
    return max((c * sum(len(known[w].decode()) for w in divmod(p, len(known))) for p, c in zip(pairs.tolist(), n.tolist(), strict=True)), default=0)


MEASURES = (
    Measure("words", ("text",), lambda text: text.encode().split()),  # bytes are cut at exactly the six ASCII spaces
    Measure("n_words", ("words",), len),
    Measure("word_chars", ("text",), lambda text: len(text) - sum(map(text.count, SPACES))),
    Measure("n_symbols", ("text",), lambda text: sum(map(text.count, SYMBOLS))),
    Measure("lines", ("text",), lambda text: [line for line in text.split("\n") if line.strip(SPACES)]),
    Measure("n_dup_lines", ("lines",), lambda lines: len(lines) - len(set(lines))),
    Measure("numbers", ("words",), numbered),
    Measure("n_repeat_words", ("numbers",), repeated_words),
    Measure("n_lettered", ("text",), lambda text: len(text.encode().translate(None, _NO_LETTERS).split())),  # a word without letters is gone
    Measure("n_trailing", ("lines",), lambda lines: sum(bool(_TRAILING.search(line)) for line in lines)),
    Measure("n_bullets", ("lines",), lambda lines: sum(bool(_BULLET.match(line)) for line in lines)),
    Measure("n_shouted", ("text",), lambda text: len(text.encode().translate(None, _NO_CAPITALS))),
    Measure("n_spoken", ("text",), lambda text: len(text.encode().translate(None, _NO_SMALL))),
    Measure("top_pair", ("numbers",), top_pair),
)
#: Base rules, then rules for what a corpus should not hold. Whole numbers only, so that every engine agrees.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, again: 100 * again > 20 * n),
)
RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda n, chars: chars < 2 * n or chars > 12 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > n),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda lines, again: 2 * again > len(lines)),
    Rule("without_letters", ("n_words", "n_lettered"), lambda n, lettered: 10 * lettered < 7 * n),
    Rule("trailing_dots", ("lines", "n_trailing"), lambda lines, n: 10 * n > 3 * len(lines)),
    Rule("bullets", ("lines", "n_bullets"), lambda lines, n: 10 * n > 9 * len(lines)),
    Rule("shouting", ("n_shouted", "n_spoken"), lambda loud, low: loud > low),
    Rule("one_pair", ("word_chars", "top_pair"), lambda chars, pair: 10 * pair > 3 * chars),
)


class Sheet(dict):
    """The measures of one text, each computed when first asked for. ``spent``, if given, adds up the nanoseconds of each."""

    def __init__(self, text: str | None, known: dict[str, Measure], spent: dict[str, int] | None = None):
        super().__init__(text=text or "")
        self.known, self.spent = known, spent

    def __missing__(self, name: str):
        measure = self.known[name]
        needed = [self[n] for n in measure.needs]
        if self.spent is None:
            self[name] = value = measure.of(*needed)
            return value
        began = time.perf_counter_ns()
        self[name] = value = measure.of(*needed)
        self.spent[name] = self.spent.get(name, 0) + time.perf_counter_ns() - began
        return value

    def rejected_by(self, rule: Rule) -> bool:
        return bool(rule.rejects(*(self[n] for n in rule.needs)))


def ordered(rules: tuple[Rule, ...], known: dict[str, Measure], costs: dict[str, float], rejected: np.ndarray, given: set[str]) -> list[Rule]:
    """Rules by rejections among what is still alive, per cost that they add. ``rejected``: sampled texts by rules."""

    def added(rule: Rule, have: set[str]) -> set[str]:
        new, ask = set(), list(rule.needs)
        while ask:
            name = ask.pop()
            if name not in have and name not in new and name != "text":
                new.add(name)
                ask += known[name].needs
        return new

    left, have, alive, found = list(range(len(rules))), set(given), np.ones(len(rejected), bool), []
    while left:
        gain = {k: (rejected[alive, k].sum() + 0.5) / (alive.sum() + 1) / (50 + sum(costs.get(m, 0) for m in added(rules[k], have))) for k in left}
        best = max(left, key=lambda k: (gain[k], -k))
        left.remove(best)
        have |= added(rules[best], have)
        alive &= ~rejected[:, best]
        found.append(rules[best])
    return found


@dataclass(frozen=True)
class Cascade:
    """Rules over measures. ``always`` names measures that are computed and returned for every text."""

    rules: tuple[Rule, ...] = RULES
    measures: tuple[Measure, ...] = MEASURES
    first: tuple[Rule, ...] = ()
    always: tuple[str, ...] = ()
    costs: dict[str, float] = field(default_factory=dict)

    def planned(self, docs: DataFrame, sample_rows: int = 2000, share: float = 0.2, seed: int = 11) -> Cascade:
        """The same cascade with its rules in the best order by a sample of at most ``sample_rows`` rows."""
        known, rules, first = {m.name: m for m in self.measures}, self.rules, self.first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text in batch["text"].to_pylist():
                    spent: dict[str, int] = {}
                    sheet = Sheet(text, known, spent)
                    alive = not any([sheet.rejected_by(r) for r in first])
                    rows.append((alive, [sheet.rejected_by(r) for r in rules], [spent.get(m, 0) for m in known]))
                columns = zip(*rows, strict=True) if rows else [()] * 3
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.bool_(), pa.list_(pa.bool_()), pa.list_(pa.int64())), strict=True)], names=["alive", "rejected", "spent"])

        rows = docs.select("text").sample(share, seed).mapInArrow(run, "alive boolean, rejected array<boolean>, spent array<long>").take(sample_rows)
        if not rows:
            return self
        costs = dict(zip(known, np.mean([r.spent for r in rows], axis=0), strict=True))
        rejected = np.array([r.rejected for r in rows if r.alive], bool).reshape(-1, len(rules))
        given = {m for m in self.always} | {n for r in first for n in r.needs}
        for name in list(given):
            given.update(known[name].needs)
        return Cascade(tuple(ordered(rules, known, costs, rejected, given)), self.measures, first, self.always, costs)

    def judge(self, docs: DataFrame, failed: str = "failed", n_rules: str = "n_rules") -> DataFrame:
        """``docs`` with the measures of ``always``, the first rule that rejects (null: kept) and the number of rules asked.

        ``docs`` may hold columns of any other names.
        """
        known, rules, always, columns = {m.name: m for m in self.measures}, (*self.first, *self.rules), self.always, docs.columns
        clash = {*always, failed, n_rules} & set(columns)
        if clash:
            raise ValueError(f"rename these columns first: {sorted(clash)}")
        schema = StructType(list(docs.schema.fields))
        for name in always:
            schema = schema.add(name, LongType())
        schema = schema.add(failed, StringType()).add(n_rules, LongType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values: list[list[int]] = [[] for _ in always]
                names, asked = [], []
                for text in batch["text"].to_pylist():
                    sheet = Sheet(text, known)
                    for k, name in enumerate(always):
                        values[k].append(sheet[name])
                    for n, rule in enumerate(rules, 1):
                        if sheet.rejected_by(rule):
                            names.append(rule.name)
                            break
                    else:
                        names.append(None)
                    asked.append(n if rules else 0)
                own = [pa.array(v, pa.int64()) for v in values] + [pa.array(names, pa.string()), pa.array(asked, pa.int64())]
                yield pa.RecordBatch.from_arrays(batch.columns + own, names=schema.names)

        return docs.mapInArrow(run, schema)


#: What the query returns of every text, besides the number of words.
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op11_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cascade = Cascade(first=BASE, always=("n_words", *COUNTS)).planned(docs)
    judged = cascade.judge(docs)
    base = F.col("failed").isin(*[r.name for r in BASE])
    return judged.select("doc_id", "n_words", *COUNTS, F.coalesce(base, F.lit(False)).alias("base_failed"), F.col("failed").isNull().alias("kept"))


OP11_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (select r, unnest(range(1, len(w) + 1)) as k, unnest(w) as word, w from d
), g as (select r, k, word, case when k <= len(w) - 4 then array_to_string(w[k : k + 4], ' ') end as five, case when k < len(w) then word || ' ' || w[k + 1] end as two, case when k < len(w) then length(word) + length(w[k + 1]) end as chars from p
), f as (select r, five from g where five is not null group by all having count(*) > 1
), c as (select r, count(distinct place) as n_repeat_words from (select r, unnest(range(k, k + 5)) as place from g join f using (r, five)) group by r
), b as (select r, max(m) as top_pair from (select r, count(*) * max(chars) as m from g where two is not null group by r, two having count(*) > 1) group by r
), s as (select r, count(*) filter (regexp_matches(word, '[A-Za-z\x{80}-\x{10FFFF}]')) as n_lettered, sum(length(word)) as word_chars from g group by r
), l as (select r, line from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')
), n as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines, count(*) filter (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) as n_trailing,
    count(*) filter (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) as n_bullets
  from l group by r
), m as (
  select doc_id, len(w) as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines, coalesce(n_trailing, 0) as n_trailing, coalesce(n_bullets, 0) as n_bullets, coalesce(n_lettered, 0) as n_lettered, coalesce(top_pair, 0) as top_pair,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_shouted, length(regexp_replace(t, '[^a-z]', '', 'g')) as n_spoken
  from d left join c using (r) left join b using (r) left join s using (r) left join n using (r)
), v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 12 * n_words or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or 10 * n_lettered < 7 * n_words
    or 10 * n_trailing > 3 * n_lines or 10 * n_bullets > 9 * n_lines or n_shouted > n_spoken or 10 * top_pair > 3 * word_chars) as kept
from v
"""
