"""Quality rules, line first.

Every line is judged on its own by punctuation, navigation and boilerplate
rules; lines that fail are removed, and a document that loses too large a
share of its word characters is rejected, as is one that fails the base rules
(too few words, or too many words inside repeated three-word windows).

Cases: a null text counts as empty (no words, base rules fail, not kept; the
cleaned text is empty).  Texts and lines of any length are judged whole, and alike: distinct
words are counted in fixed windows of a line.  Repeated rows
are judged one by one and all returned.  An empty table gives an empty result.
Extra columns pass through ``clean_documents`` untouched; ``quality_scores``
returns only its own columns, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import WORD_SPACE, documents, prepare

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Phrases of page furniture, looked for in short lines.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "javascript is disabled", "enable javascript", "click here", "read more",
    "sign in", "log in", "subscribe to our newsletter", "share this", "back to top", "skip to content",
)

# Words that separate entries of a menu.
SEPARATORS = ("|", ">", ">>", "»", "·", "•", "/")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line and document rules."""

    max_symbol_share: float = 0.10      # symbols / characters that aren't white space
    max_capital_share: float = 0.60     # words in capitals / words, lines of min_capital_words on
    min_capital_words: int = 5
    max_bang_share: float = 0.30        # words that end in !! / words
    max_separators_per_word: float = 0.20   # stand-alone | > » · / words: navigation
    min_distinct_share: float = 0.20    # distinct words of each window / words, lines of min_words on
    min_words: int = 20
    window: int = 200                   # words of a window; a share of whole lines would fall with their length
    boilerplate_words: int = 12         # a furniture phrase removes lines up to this length
    max_lost_share: float = 0.40        # word characters of removed lines / all
    base_min_words: int = 50
    base_max_repeat_pct: int = 50


_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_WORD = re.compile(f"[^{re.escape(WORD_SPACE)}]+")


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
    k = len(ids)
    if k < 1 << 21:
        window = (w[:-2] * k + w[1:-1]) * k + w[2:]
    else:   # number the pairs first, so that the window's key fits 64 bits
        pairs = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
        window = pairs[:-1] * n + pairs[1:]
    in_order = np.sort(window)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(window, twice)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def line_fails(line: str, words: list[str], chars: int, symbols: int, rules: LineRules) -> str | None:
    """Name of the first rule that removes a line with words, or None.

    ``chars`` counts its characters in words, ``symbols`` its symbols.
    """
    n_words = len(words)
    separators = sum(words.count(s) for s in SEPARATORS if s in line)
    if symbols > rules.max_symbol_share * chars:
        return "navigation" if separators > rules.max_separators_per_word * n_words else "punctuation"
    if separators > rules.max_separators_per_word * n_words and n_words > 3:
        return "navigation"
    if "!!" in line and sum(w.endswith("!!") for w in words) > rules.max_bang_share * n_words:
        return "punctuation"
    if n_words >= rules.min_capital_words and sum(map(str.isupper, words)) > rules.max_capital_share * n_words:
        return "punctuation"
    if n_words >= rules.min_words:
        distinct = sum(len(set(words[k:k + rules.window])) for k in range(0, n_words, rules.window))
        if distinct < rules.min_distinct_share * n_words:
            return "boilerplate"
    if n_words <= rules.boilerplate_words and _FURNITURE.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str | None, rules: LineRules) -> dict:
    """All figures of one document, and its text without the failed lines."""
    text = text or ""
    words, kept_lines, seen = [], [], set()
    chars = symbols = lost = dup = 0
    for line in text.split("\n"):
        line_words = _WORD.findall(line)
        if not line_words:
            kept_lines.append(line)
            continue
        words += line_words
        line_chars = len(line) - sum(map(line.count, WORD_SPACE))
        line_symbols = sum(map(line.count, SYMBOLS))
        chars += line_chars
        symbols += line_symbols
        if line in seen:
            dup += 1
            fails = "boilerplate"
        else:
            seen.add(line)
            fails = line_fails(line, line_words, line_chars, line_symbols, rules)
        if fails:
            lost += line_chars
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    base_failed = len(words) < rules.base_min_words or 100 * repeat > rules.base_max_repeat_pct * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": symbols,
        "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost_share * chars,
        "lost_chars": lost, "clean_text": "\n".join(kept_lines),
    }


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def quality_scores(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document with its figures and verdict, in one map pass."""
    prepare(docs.sparkSession)
    names = [c.split()[0] for c in _FIGURES.split(", ")] + ["clean_text"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [judge(t, rules) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [r[c] for r in rows] for c in names}})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, f"doc_id long, {_FIGURES}" + ", clean_text string" * with_text)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text",
                    chars_col: str | None = "n_chars") -> DataFrame:
    """Documents that are kept, without the lines that failed; same columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [judge(t, rules) for t in b.iloc[:, at]]
            out = b.copy()
            out.isetitem(at, pd.Series([r["clean_text"] for r in rows], index=b.index, dtype=object))
            yield out[np.array([r["kept"] for r in rows], dtype=bool)]

    kept = docs.mapInPandas(run, docs.schema)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        kept = kept.withColumn(chars_col, F.char_length(text_col).cast(kind))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    return quality_scores(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
used AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
         len(ws) AS n, length(array_to_string(ws, '')) AS chars,
         length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
         len(list_filter(ws, lambda w: w IN ('|', '>', '>>', '»', '·', '•', '/'))) AS separators
  FROM lines WHERE len(ws) > 0),
judged AS (
  SELECT *, again OR symbols > 0.10 * chars OR (separators > 0.20 * n AND n > 3)
         OR len(list_filter(ws, lambda w: ends_with(w, '!!'))) > 0.30 * n
         OR (n >= 5 AND len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w))) > 0.60 * n)
         OR (n >= 20 AND list_sum(list_transform(range(1, n + 1, 200), lambda k: len(list_distinct(ws[k:k + 199])))) < 0.20 * n)
         OR (n <= 12 AND regexp_matches(lower(line), 'all rights reserved|accept cookies|cookie policy|privacy policy|terms of use|terms of service|javascript is disabled|enable javascript|click here|read more|sign in|log in|subscribe to our newsletter|share this|back to top|skip to content')) AS fails
  FROM used),
figures AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
         count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id),
words AS (
  SELECT doc_id, i, ws[i] AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
  SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM windows),
covered AS (
  SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS c
  FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM documents d LEFT JOIN figures USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.40 * word_chars AS kept,
       lost_chars
FROM joined
"""
