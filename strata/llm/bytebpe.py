"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (token bytes and their rank, one a line) gives the whole model:

* *byte-to-character mapping*: every byte stands for one printable character,
  so that token bytes become the strings that the ``tokenizers`` library works
  on; decoding reverses that table.
* *merges*: each token's last merge is found by merging its own bytes in rank
  order, so a pair list of the library does what ranks do.  A piece that is a
  token as a whole is taken as it is.
* *offsets*: the library's places of each token in the text, in code points.

Encoding is one ``mapInArrow`` pass.  Texts are cut before white space that
follows something else: the pattern never matches across such a place and never
looks behind it, so pieces, tokens and offsets are those of the whole text.
The library gets the batch's distinct pieces of that kind that the worker does
not know yet, in groups of bounded size; each text's ids are gathered from flat
arrays.  Decoding gathers the bytes of all ids first and reads them as UTF-8
only then, since a character's bytes can lie in several tokens;
``decoded_text`` has U+FFFD for bytes that are no UTF-8.

Cases: a null text counts as empty and has no ids; null ids decode to nothing;
an unknown id raises; texts of any length are encoded whole; repeated rows are
all returned; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from strata.llm.common import documents, prepare

GROUP_BYTES = 1 << 20       # bytes of texts that are worked on at once
KNOWN_CHARS = 1 << 22       # code points of pieces that a worker remembers
# Unicode's white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """Character of each byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are merged last when the token's bytes are merged in rank order."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 256))
        if parts[best] + parts[best + 1] not in ranks:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return tuple(parts) if len(parts) == 2 else None


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` tokenizer without special tokens that encodes as the ranks say."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_characters()
    written_as = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (m := last_merge(token, ranks)):
            merges.append((written_as[m[0]], written_as[m[1]]))
    tok = Tokenizer(models.BPE(vocab={written_as[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Encoder:
    """Encodes texts; remembers pieces within a fixed bound.

    ``cut`` is for patterns that match nothing across the start of white
    space, such as the one of the public rank files; without it whole texts
    go to the library.
    """

    def __init__(self, tok, cut: bool = True, offsets: bool = True):
        self.tok, self.cut, self.offsets = tok, cut, offsets
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.counts, self.firsts, self.sizes = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids, self.starts, self.ends = (np.zeros(0, dtype=np.int32) for _ in range(3))

    def learn(self, pieces: list[str]) -> None:
        """Let the library encode new pieces and add them to the flat arrays."""
        got = (self.tok.encode_batch if self.offsets else self.tok.encode_batch_fast)(pieces, add_special_tokens=False)
        lists = [e.ids for e in got]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=counts.sum())])
        if self.offsets:
            places = np.array([p for e in got for p in e.offsets], dtype=np.int32).reshape(-1, 2)
            self.starts, self.ends = np.concatenate([self.starts, places[:, 0]]), np.concatenate([self.ends, places[:, 1]])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))])
        self.chars += sum(map(len, pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each text, and the flat ids (and starts and ends, if wanted) of all of them."""
        split = [_PIECE.findall(t) if self.cut else [t] * (t != "") for t in texts]
        if self.chars > KNOWN_CHARS:
            self.forget()
        flat = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        for i in range(0, len(new), 20_000):
            self.learn(new[i:i + 20_000])
        row = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[flat.indices.to_numpy()]
        counts = self.counts[row]
        at = ragged(self.firsts[row], counts)
        n_pieces = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(n_pieces)
        per_text = before[ends] - before[ends - n_pieces]
        out = [self.ids[at]]
        if self.offsets:
            # a piece's place in its text: what the text's pieces before it hold
            sizes = self.sizes[row]
            shift = np.cumsum(sizes) - sizes
            chars = np.concatenate([[0], np.cumsum(sizes)])[ends - n_pieces]
            shift = np.repeat(shift - np.repeat(chars, n_pieces), counts)
            out += [(places[at] + shift).astype(np.int32) for places in (self.starts, self.ends)]
        return per_text, out


class ByteTable:
    """Bytes of every id as one flat array, for gathering whole id lists at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(self.size, dtype=bool)
        self.known[list(ranks.values())] = True
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The flat bytes of all ids, and how many each id has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.known[ids].all()):
            raise ValueError("an id is not in the rank file")
        n = self.lengths[ids]
        return self.flat[ragged(self.starts[ids], n)], n

    def decode_lists(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes of consecutive id lists of the given lengths."""
        data, n = self.decode(ids)
        per_id = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], per_id[np.cumsum(counts)]]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


_MODELS: dict[tuple, object] = {}


def _model(key: tuple, make):
    """One model of each kind a worker, so that its tables don't grow with the queries."""
    if _MODELS.get(key[0], (None,))[0] != key:
        _MODELS[key[0]] = (key, make())
    return _MODELS[key[0]][1]


def _with_columns(batch: pa.RecordBatch, names: list[str], new: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: new[n] if n in new else batch.column(n) for n in names})


def _groups(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most``, one row at least."""
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))


def _decoded_columns(table: ByteTable, counts: np.ndarray, ids: np.ndarray, as_text: bool) -> dict:
    out = {"decoded": table.decode_lists(counts, ids)}
    if as_text:
        out["decoded_text"] = pa.array([d.decode("utf-8", "replace") for d in out["decoded"].to_pylist()], type=pa.string())
    return out


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_text: bool = True,
           cut: bool = True, offsets: bool = True, decoded: bool = False) -> DataFrame:
    """``df`` with ``ids``, ``starts`` and ``ends`` (code points, end exclusive) of every token.

    A character whose bytes lie in several tokens is in each one's range.
    ``offsets=False`` leaves the places out; ``decoded`` adds the bytes that
    the ids decode to, in the same pass.  Columns of these names in ``df`` are
    replaced.  ``ranks_path`` must name the rank file on every executor; it is
    read once per Python worker.  ``cut`` must be false for a pattern that
    matches across the start of white space.
    """
    prepare(df.sparkSession)
    new = ["ids", "starts", "ends"][:3 if offsets else 1]
    fields = [StructField(c, ArrayType(IntegerType())) for c in new] + [StructField("decoded", BinaryType())] * decoded
    added = {f.name for f in fields}
    source = df.drop(*[c for c in added if c != text_col])
    schema = StructType([f for f in source.schema.fields if f.name not in added and (keep_text or f.name != text_col)] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(ranks_path)
        encoder = _model(("encode", ranks_path, pattern, cut, offsets),
                         lambda: Encoder(build_tokenizer(ranks, pattern), cut, offsets))
        table = _model(("decode", ranks_path), lambda: ByteTable(ranks)) if decoded else None
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            for b in _groups(batch, sizes, GROUP_BYTES):
                counts, flat = encoder.encode([t or "" for t in b.column(text_col).to_pylist()])
                made = {c: _lists(counts, f) for c, f in zip(new, flat)}
                if decoded:
                    made |= _decoded_columns(table, counts, flat[0], False)
                yield _with_columns(b, names, made)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (the bytes) and ``decoded_text`` in place of columns of these names."""
    prepare(df.sparkSession)
    source = df.drop("decoded", "decoded_text")
    schema = StructType([*source.schema.fields, StructField("decoded", BinaryType()), StructField("decoded_text", StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _model(("decode", ranks_path), lambda: ByteTable(read_ranks(ranks_path)))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for b in _groups(batch, sizes, GROUP_BYTES):
                lists = b.column(ids_col)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield _with_columns(b, names, _decoded_columns(table, counts, ids, True))

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level ranks, and the digest of what they decode to."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = encode(docs, path, public_tokenizers.PATTERN, keep_text=False, offsets=False, decoded=True)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
