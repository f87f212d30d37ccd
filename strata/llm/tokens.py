"""Token counts by rank-synchronous array merging.

The pieces and scores of a sentencepiece BPE model drive an own encoder that
only counts.  A batch's distinct pre-tokens are held as one ragged symbol
array (flat symbols + row ends); in each round every row applies its
lowest-rank adjacent pair, leftmost first, at the same time as all other rows,
until no row has a pair left; the surviving symbols are the tokens (a symbol
that is no piece counts its UTF-8 bytes, the model's byte fallback).

Pre-tokens are exact: no piece has the space mark after another character, so
no merge crosses the place before a space mark, nor a line break or tab, which
no piece contains (both are checked when the model is read).  A pre-token of more than
``LONG`` symbols follows the same rule on a heap, which is linear-logarithmic
where rounds would be quadratic.

Cases: a null text counts as empty (0 bytes, 0 tokens).  Texts are counted
whole.  Repeated rows are all returned; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, prepare

SPACE = "▁"
LONG = 192                 # symbols from which a pre-token goes to the heap
CACHE = 400_000            # distinct pre-tokens a worker remembers
_NO_PAIR = np.int64(1 << 40)


class MergeTable:
    """Symbols, merge ranks and merge results of one BPE model.

    The tables are as large as the vocabulary, whatever the data.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) or re.search(r"[\n\t]", p) for p in usable):
            raise ValueError("the model has pieces that cross pre-token bounds")
        if sp.normalize("a  b\nﬁ ") != f"{SPACE}a{SPACE}{SPACE}b\nﬁ{SPACE}":
            raise ValueError("the model changes texts before it encodes them")
        order = {s: r for r, s in enumerate(sorted(set(usable.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(usable)}
        # every way to cut a piece in two pieces or characters is a merge
        self.symbols: dict[str, int] = dict(self.ids)
        merges = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (len(left) == 1 or left in self.ids) and (len(right) == 1 or right in self.ids):
                    a = self.symbols.setdefault(left, len(self.symbols))
                    b = self.symbols.setdefault(right, len(self.symbols))
                    merges[a, b] = (order[usable[piece]], i)
        self.pieces = len(self.ids)
        keys = np.array([(a << 32) | b for a, b in merges], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        values = np.array(list(merges.values()), dtype=np.int64).reshape(-1, 2)[by]
        self.ranks, self.results = values[:, 0], values[:, 1]
        self.merges = merges
        # by code point: the symbol, and the tokens of a character that stays alone
        points = np.arange(0x110000)
        self.char_symbol = np.full(len(points), -1, dtype=np.int64)
        self.char_cost = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        for piece, i in self.symbols.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
                if i < self.pieces:
                    self.char_cost[ord(piece)] = 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the rank is _NO_PAIR where there is no merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NO_PAIR), self.results[at]

    def count_batch(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged together in rounds."""
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym, cost = self.char_symbol[flat], self.char_cost[flat]
        row = np.repeat(np.arange(len(tokens)), sizes)
        total = np.zeros(len(tokens), dtype=np.int64)
        rank = np.full(len(sym), _NO_PAIR)
        made = np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.pair_ranks(sym[:-1], sym[1:])
            rank[:-1][row[:-1] != row[1:]] = _NO_PAIR
        while len(sym):
            n = len(sym)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            # rank first, then place: one minimum per row is its leftmost lowest pair
            best = np.minimum.reduceat(rank * n + np.arange(n), starts)
            live = best < _NO_PAIR * n
            place = best[live] % n
            sym[place] = made[place]
            cost[place] = 1
            # only the pairs beside a merge change: with the symbol after it and before it
            end = place + 2
            inside = (end < n) & (row[np.minimum(end, n - 1)] == row[place])
            rank[place] = _NO_PAIR
            rank[place[inside]], made[place[inside]] = self.pair_ranks(sym[place[inside]], sym[end[inside]])
            left = place[place > 0]
            left = left[row[left - 1] == row[left]] - 1
            rank[left], made[left] = self.pair_ranks(sym[left], sym[left + 1])
            stay = np.ones(n, dtype=bool)
            stay[place + 1] = False
            if not live.all():
                done = np.repeat(~live, np.diff(np.r_[starts, n]))
                total += np.bincount(row[done], weights=cost[done], minlength=len(tokens)).astype(np.int64)
                stay &= ~done
            sym, cost, row, rank, made = sym[stay], cost[stay], row[stay], rank[stay], made[stay]
        return total

    def count_long(self, token: str) -> int:
        """The same rule for one long pre-token: a heap over a linked list."""
        sym = [self.symbols.get(c, -1) for c in token]
        n = len(sym)
        cost = [int(self.char_cost[ord(c)]) for c in token]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((sym[i], sym[j]))):
                heapq.heappush(heap, (m[0], i, sym[i], sym[j], m[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            alive[j] = False
            sym[i], cost[i], after[i] = made, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(c for c, a in zip(cost, alive) if a)


_PRE = re.compile(f"{SPACE}+[^{SPACE}\n\t]*|[^{SPACE}\n\t]+|[\n\t]")


def pre_tokens(text: str) -> list[str]:
    """Stretches that no merge crosses; the model puts a space mark in front."""
    return _PRE.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Counter:
    """Counts texts; remembers pre-tokens within a fixed bound."""

    def __init__(self, model_path: str):
        self.table = MergeTable(model_path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        split = [pre_tokens(t or "") for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        todo = [w for w in set().union(*split) if w not in self.known]
        short = sorted((w for w in todo if len(w) <= LONG), key=len)
        for i in range(0, len(short), 20_000):
            part = short[i:i + 20_000]
            self.known.update(zip(part, self.table.count_batch(part).tolist()))
        for w in todo:
            if len(w) > LONG:
                self.known[w] = self.table.count_long(w)
        return [sum(map(self.known.__getitem__, words)) for words in split]


_COUNTER: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, in one map pass.

    ``model_path`` must name the model on every executor; it is read once per
    Python worker.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_path not in _COUNTER:
            _COUNTER.clear()
            _COUNTER[model_path] = Counter(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"],
                                "n_tokens": _COUNTER[model_path].count(b["text"].tolist())})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    counted = narrow.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the 32k BPE piece model gives them."""
    import public_tokenizers
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
