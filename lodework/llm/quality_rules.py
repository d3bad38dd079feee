"""Quality rules as a short-circuit cascade.

Every rule is a function of one document's statistics. On a random sample of all documents, of whatever size, each
rule's cost (seconds a document) and selectivity (share rejected) are measured where the documents are; the cascade then
runs the rules in the order of rejection per cost, and a document leaves it at the first rule that rejects it. The
order changes how much work is done and never the verdict, which is the conjunction of the rules.

Words are what lies between ASCII white space, in all rules; a letter is what Unicode calls one (category L).

Nulls and edge cases: a null or empty text has no words, all counts are 0 and it fails the base test
(fewer than 10 words). Very long texts are judged whole. Rules of equal rejection per cost keep the order they are given
in. Repeated rows and ids are judged one by one. Other columns are carried along, except ones whose names clash with the
result's, which are replaced. An empty table gives no row.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, tidy

#: Fixed values of the base statistics.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5


class Stats:
    """One text's statistics. The base ones are made at once, others when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self._spelt: list[str] | None = None

    def spelt(self) -> list[str]:
        """The words as characters."""
        if self._spelt is None:
            self._spelt = b" ".join(self.words).decode("utf-8", "surrogatepass").split(" ") if self.words else []
        return self._spelt

    def base(self) -> tuple[int, int, int, int]:
        raw, words = self.raw, self.words
        self.word_chars = len(self.text) - (len(raw) - sum(map(len, words)))
        self.n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        self.n_dup_lines = self.n_lines = 0
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                self.n_lines += 1
                self.n_dup_lines += line in seen
                seen.add(line)
        self.n_repeat_words = repeat_words(words)
        return self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text, the first find included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(seen := set(grams)) == len(grams):
        return 0
    twice: set = set()
    for g in grams:
        if g in seen:
            seen.discard(g)
        else:
            twice.add(g)
    total = end = 0
    for i, g in enumerate(grams):
        if g in twice:
            total += i + window - max(end, i)
            end = i + window
    return total


@dataclass(frozen=True)
class Rule:
    """rejects(stats) is true for a document that has to go."""

    name: str
    rejects: Callable[[Stats], bool]


def _capital(word: str) -> bool:
    """It has a capital letter and no small one."""
    if word.isascii():
        return word.isupper()
    kinds = {unicodedata.category(c) for c in word}
    return "Lu" in kinds and "Ll" not in kinds


def _shouting(s: Stats) -> bool:
    """More than half of the words of two letters or more are in capitals."""
    words = [w for w in s.spelt() if sum(map(str.isalpha, w)) > 1]
    return 2 * sum(map(_capital, words)) > len(words) > 0


def _wordless(s: Stats) -> bool:
    """Fewer than four in five words hold a letter."""
    return 5 * sum(1 for w in s.spelt() if w.isalpha() or any(map(str.isalpha, w))) < 4 * s.n_words


#: Symbols to words over 0.1, repeated lines over 0.3, mean word length outside 3 to 10: published thresholds of
#: rule-based web-corpus filters. Integer arithmetic only, so that SQL gives the same verdicts.
RULES = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("duplicate_lines", lambda s: 10 * s.n_dup_lines > 3 * s.n_lines),
    Rule("short_words", lambda s: s.word_chars < 3 * s.n_words),
    Rule("long_words", lambda s: s.word_chars > 10 * s.n_words),
    Rule("shouting", _shouting),
    Rule("wordless", _wordless),
)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def measure(rules: tuple[Rule, ...], texts: list[str | None]) -> list[tuple[int, float]]:
    """For each rule how many of the texts it rejects and the seconds that takes. Each goes over all of them, so that
    selectivities aren't conditioned on an order, with statistics of its own, so that none pays for another."""
    out = []
    for rule in rules:
        stats = [Stats(t) for t in texts]
        for s in stats:
            s.base()
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, stats))
        out.append((rejected, time.perf_counter() - began))
    return out


def ranked(rules: tuple[Rule, ...], measured: list[tuple[int, float]]) -> list[Rule]:
    """The rules by descending rejection per cost. One that rejects nothing goes last, cheapest first."""
    rank = [(-rejected / (cost + 1e-9), cost, k) for k, (rejected, cost) in enumerate(measured)]
    return [rules[k] for *_, k in sorted(rank)]


def order_rules(rules: tuple[Rule, ...], texts: list[str | None]) -> list[Rule]:
    return ranked(rules, measure(rules, texts))


def measured_on(docs: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int) -> list[tuple[int, float]]:
    """measure() on about sample_rows rows, drawn alike from all of the table; only the sums come back."""
    share = min(1.0, sample_rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                got = measure(rules, batch.column(0).slice(a, 64).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["rule", "rejected", "seconds"])

    made = docs.select(text).sample(share, 11).mapInArrow(tidy(run), "rule int, rejected long, seconds double")
    sums = {r[0]: (r[1], r[2]) for r in made.groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()}
    return [sums.get(k, (0, 0.0)) for k in range(len(rules))]


def judge(rules: list[Rule], stats: Stats) -> str | None:
    """The first rule that rejects, in the cascade's order."""
    return next((r.name for r in rules if r.rejects(stats)), None)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """docs with the statistics and the verdict for each row. Costs and selectivities are estimated on about sample_rows rows;
    that changes the order of the rules, so the speed, and no verdict."""
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    carried = docs.select(*[c for c in docs.columns if c not in names])
    ordered = ranked(rules, measured_on(docs, text, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                s = Stats(t)
                base = s.base()
                failed = base_failed(s.n_words, base[3])
                row = (s.n_words, *base, failed, not failed and judge(ordered, s) is None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*batch.schema.names, *names])

    return carried.mapInArrow(tidy(run), StructType([*carried.schema.fields, *StructType.fromDDL(OUT).fields]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).drop("text")


QUERIES = {"op7_quality_rules": op7}

ORACLE = {
    "op7_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, text, w, len(w) AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS g FROM t),
o AS (SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS pos FROM l),
r AS (SELECT doc_id, pos FROM o QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - pos, 5))) AS n_repeat FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM r) GROUP BY doc_id),
b AS (SELECT l.doc_id, w, n AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  len(list_filter(w, lambda x: length(regexp_replace(x, '[^\pL]', '', 'g')) > 1)) AS longer,
  len(list_filter(w, lambda x: length(regexp_replace(x, '[^\pL]', '', 'g')) > 1 AND NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}'))) AS upper,
  len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS lettered FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (10 * n_dup_lines > 3 * n_lines) AND NOT (word_chars < 3 * n_words) AND NOT (word_chars > 10 * n_words)
  AND NOT (2 * upper > longer AND longer > 0) AND NOT (5 * lettered < 4 * n_words) AS kept
FROM f"""
}
