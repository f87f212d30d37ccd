"""URL filters: one bit-parallel wildcard automaton for all rules.

Glob rules are packed, one bit per character, into multiword Shift-And masks.
Each URL's canonical form is read once, byte by byte, and every step moves all
patterns of all URLs of a batch at the same time: literals shift a bit to the
next place, wildcards keep a bit where it is.

Glob language: ``?`` any byte but ``/``; ``*`` any run of bytes but ``/``;
``**`` any run; a backslash takes the next character as it is.  Patterns match
the whole canonical form, which is ``.`` + host + path (host with A-Z
lower-cased, without scheme, query and fragment), so ``*.net/**`` is the host
``net`` with all its subdomains.

Cases: a null URL, or one without ``://``, has an empty host and path, which
is judged as such.  URLs of any length are read whole.  Repeated rows are all
returned, an empty table gives no rows, an empty rule list leaves the glob
verdict, and extra columns are not read.  Among fitting rules the longest
(host and path together) wins; of equally long ones, the first listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import prepare
from strata.sources.tables import read_table


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that begin so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return "*." + _escaped(self.host) + _escaped(self.path) + "**"


# The rules the query judges by.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

# Globs that block a URL which no rule fits.
BLOCK_GLOBS = ("**spam**", "**casino**", "**cheap-pills**", "**porn**", "**.exe", "**/wp-login**")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class ShiftAnd:
    """All globs in one automaton of ``words`` 64-bit words."""

    def __init__(self, globs: list[str] | tuple[str, ...]):
        places: list[tuple[int, int | None, str]] = []  # (pattern, byte or None, loop) by bit
        self.first, self.last = [], []
        for k, glob in enumerate(globs):
            self.first.append(len(places))
            places.append((k, -1, ""))      # where the pattern begins
            raw, i = glob.encode(), 0
            while i < len(raw):
                c = raw[i:i + 1]
                if c == b"*":
                    wide = raw[i + 1:i + 2] == b"*"
                    p, byte, loop = places[-1]
                    places[-1] = (p, byte, "any" if wide or loop == "any" else "name")
                    i += 1 + wide
                    continue
                if c == b"\\" and i + 1 < len(raw):
                    i += 1
                    places.append((k, raw[i], ""))
                else:
                    places.append((k, None if c == b"?" else raw[i], ""))
                i += 1
            self.last.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.moves = np.zeros((256, self.words), dtype=np.uint64)    # bits a byte may shift into
        self.stays = np.zeros((256, self.words), dtype=np.uint64)    # bits a byte leaves set
        self.begin = np.zeros(self.words, dtype=np.uint64)
        for bit, (_, byte, loop) in enumerate(places):
            w, m = bit // 64, np.uint64(1 << bit % 64)
            if byte is None:
                self.moves[:, w] |= m
                self.moves[ord("/"), w] &= ~m
            elif byte >= 0:
                self.moves[byte, w] |= m
            if loop:
                self.stays[:, w] |= m
                if loop == "name":
                    self.stays[ord("/"), w] &= ~m
        for bit in self.first:
            self.begin[bit // 64] |= np.uint64(1 << bit % 64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """States after the last byte, one row of words per text."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begins = (ends - sizes)[order]
        state = np.tile(self.begin, (len(texts), 1))
        longest = int(sizes.max(initial=0))
        # texts longer than p come first, so step p works on a prefix of the rows
        active = len(texts) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        for p in range(longest):
            n = int(active[p])
            c = flat[begins[:n] + p]
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.moves[c]) | (d & self.stays[c])
        out = np.empty_like(state)
        out[order] = state
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: texts by globs."""
        state = self.run(texts)
        got = [(state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) for b in self.last]
        return np.array(got, dtype=bool).T.reshape(len(texts), len(self.last))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, block: tuple[str, ...] = BLOCK_GLOBS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, globs`` for every row.

    ``rule`` is the winning rule or null, ``verdict`` its verdict, or else
    ``block`` if a block glob matches and ``allow`` if none does; ``globs``
    lists the block globs that match, whatever the rule says.
    """
    prepare(pages.sparkSession)
    automaton = ShiftAnd([r.glob for r in rules] + list(block))
    # longest first, then as listed: the first that matches wins
    by_length = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = automaton.matches([("." + h + p).encode("utf-8", "surrogatepass") for h, p in zip(b["host"], b["path"])])
            ruled, globbed = hit[:, by_length], hit[:, len(rules):]
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1), -1) if rules else np.full(len(b), -1)
            won = [rules[by_length[k]] if k >= 0 else None for k in first]
            yield b.assign(
                rule=[r.name if r else None for r in won],
                verdict=[r.verdict if r else "block" if g else "allow" for r, g in zip(won, globbed.any(axis=1))],
                globs=[[block[k] for k in np.flatnonzero(g)] for g in globbed])

    url = F.col(url_col)
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return narrow.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, globs array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return judge_urls(read_table(spark, sf_dir, "pages")).drop("globs")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                     ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.rverdict,
                CASE WHEN contains(host || path, 'spam') OR contains(host || path, 'casino')
                       OR contains(host || path, 'cheap-pills') OR contains(host || path, 'porn')
                       OR ends_with(host || path, '.exe') OR contains(path, '/wp-login')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.k = 1
"""
