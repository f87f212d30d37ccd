"""Operators 11 to 13 against their libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import SF, awkward, awkward_rows  # noqa: E402

from strata.llm import bytebpe, jaccard, licenses, toxicity, trie, whitening  # noqa: E402

RANKS = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ------------------------------------------------------------------ 11

def models(name):
    import public_tokenizers as P
    import tiktoken
    ranks = bytebpe.read_ranks(P.path(name))
    own = bytebpe.build_tokenizer(ranks, P.PATTERN)
    return ranks, own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", RANKS)
def test_encoder_equals_the_rank_library(name):
    ranks, own, theirs = models(name)
    table = bytebpe.ByteTable(ranks)
    texts = ["", " ", "a", "  a  b\n\n c", "<|endoftext|> it's we'll", "naïve café 😀👩‍👩‍👧 日本語のテキスト", "x" * 3000, "é" * 999, " 　 \x1c!\x1c \x85",
             "1234567 1 2  3", "\t\r\n", "word " * 5000] + [t or "" for _, t, *_ in awkward_rows()]
    rng = np.random.default_rng(5)
    alphabet = [*"ab1 \n\t!.'é日  \x1c😀"]
    texts += ["".join(rng.choice(alphabet, size=40)) for _ in range(300)]
    for cut in (True, False):
        counts, (flat, starts, ends) = bytebpe.Encoder(own, cut).encode(texts)
        assert bytebpe.Encoder(own, cut, False).encode(texts)[1][0].tolist() == flat.tolist()
        assert table.decode_lists(counts, flat).to_pylist() == [t.encode() for t in texts]
        for text, end, n in zip(texts, np.cumsum(counts), counts):
            at = slice(end - n, end)
            assert flat[at].tolist() == theirs.encode_ordinary(text)
            assert list(zip(starts[at].tolist(), ends[at].tolist())) == own.encode(text, add_special_tokens=False).offsets


def test_encoder_on_every_character(name=RANKS[0]):
    _, own, theirs = models(name)
    encoder = bytebpe.Encoder(own)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}!{chr(c)}! {chr(c)}{chr(c)} " for c in points[i:i + 4096])
        assert encoder.encode([text])[1][0].tolist() == theirs.encode_ordinary(text)


def test_encoder_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN_CHARS", 50)
    _, own, theirs = models(RANKS[0])
    texts = [f"some words number {i} of many" for i in range(200)]
    encoder = bytebpe.Encoder(own)
    for text in texts:
        assert encoder.encode([text])[1][0].tolist() == theirs.encode_ordinary(text)
        assert encoder.chars < 50 + len(text)


def test_merges_that_are_not_pairs_of_tokens_are_left_to_whole_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256}
    assert bytebpe.last_merge(b"xyz", ranks) is None
    tok = bytebpe.build_tokenizer(ranks, r"\S+|\s+")
    assert tok.encode("xyz xyza").ids == [256, 32, 120, 121, 122, 97]


def test_encode_and_decode_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(bytebpe, "GROUP_BYTES", 100)
    import public_tokenizers as P
    path = P.path(RANKS[0])
    df = awkward(spark)
    from pyspark.sql import functions as F
    df = df.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    got = bytebpe.decode(bytebpe.encode(df, path, P.PATTERN), path)
    rows = got.collect()
    assert len(rows) == len(awkward_rows()) and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in rows:
        text = r.text or ""
        assert bytes(r.decoded) == text.encode() and r.decoded_text == text and r.score == "clash"
        # the tokens' places cover the text in order
        assert not r.ids or (r.starts[0] == 0 and max(r.ends) == len(text) and r.starts == sorted(r.starts))
    assert bytebpe.encode(df.limit(0), path, P.PATTERN).collect() == []
    halves = spark.createDataFrame([(1, [172, 8582, 246]), (2, None), (3, [])], "i int, ids array<int>")
    out = {r.i: r for r in bytebpe.decode(halves, path).collect()}
    table = bytebpe.ByteTable(bytebpe.read_ranks(path))
    assert bytes(out[1].decoded) == table.decode(np.array([172, 8582, 246]))[0].tobytes() and "�" in out[1].decoded_text
    assert bytes(out[2].decoded) == bytes(out[3].decoded) == b""
    with pytest.raises(ValueError):
        table.decode(np.array([50256]))


def test_query_11_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    theirs = models(RANKS[0])[2]
    got = bytebpe.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


# ------------------------------------------------------------------ 12

def vectors(spark, rows):
    rows = [(i, v and [None if e is None else float(e) for e in v], *clash) for i, v, *clash in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component string")


def brute_whitening(rows):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    z = ((n * x - sums) / n).astype(float)
    values, units = np.linalg.eigh(z.T @ z / n)
    return kept, n, deviation, z, values[::-1], units[:, ::-1]


def check_whitening(got, rows, components=32):
    kept, n, deviation, z, values, units = brute_whitening(rows)
    rank = int((values > 1e-12 * values[0]).sum())
    count = min(components, rank)
    assert len(got) == len(kept) * count
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id, r.deviation][r.component] = r
    for (i, _), dev, row in zip(kept, deviation, z):
        mine = by[i, dev]
        assert sorted(mine) == list(range(1, count + 1))
        for k, r in mine.items():
            want = row @ units[:, k - 1] / math.sqrt(values[k - 1])
            assert r.n == n and abs(r.explained - values[k - 1] / values.sum()) <= 1e-9 * r.explained + 1e-15
            assert abs(abs(r.whitened) - abs(want)) < 1e-5 and r.identity_error < 1e-6
    return by


def test_query_12_against_an_eigen_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    by = check_whitening(whitening.query(spark, SF).collect(), rows)
    # one sign for all rows
    kept, n, deviation, z, values, units = brute_whitening(rows)
    for k in range(3):
        want = z @ units[:, k] / math.sqrt(values[k])
        mine = np.array([by[i, d][k + 1].whitened for (i, _), d in zip(kept, deviation)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    # strongly correlated dimensions, one constant, one copied; a very common vector
    base = rng.normal(size=(300, 3)) * [300.0, 1.0, 0.05]
    full = np.c_[base, base[:, 0] * 2, np.full(300, 7.0), base[:, 0] + base[:, 1]]
    rows = [(i, v.tolist()) for i, v in enumerate(full)] + [(1000, full[0].tolist())] * 100
    bad = [(2000, None), (2001, [None] * 6), (2002, [1.0, float("nan"), 1, 1, 1, 1]), (2003, [float("inf")] * 6), (2004, []), (2005, [-math.inf, 0, 0, 0, 0, 0])]
    odd = [(None, full[1].tolist())]
    df = vectors(spark, [(i, v, "clash", "clash") for i, v in rows + bad + odd])
    got = whitening.whitened(df).collect()
    dist = {}
    for r in got:
        dist[r.vec_id, r.deviation, r.component] = r
    kept, n, deviation, z, values, units = brute_whitening(rows + odd)
    rank = int((values > 1e-13 * values[0]).sum())
    assert {r.component for r in got} == set(range(1, rank + 1)) and len(got) == len(kept) * rank
    assert all(r.n == n and r.identity_error < 1e-4 for r in got)
    for (i, _), dev, row in zip(kept, deviation, z):
        for k in range(rank):
            assert abs(abs(dist[i, dev, k + 1].whitened) - abs(row @ units[:, k] / math.sqrt(values[k]))) < 1e-3


def test_whitening_without_variance_rows_or_entries(spark):
    same = vectors(spark, [(i, [1.0, 2.0], "a", "b") for i in range(5)])
    assert whitening.whitened(same).collect() == [] and whitening.whitened(same.limit(0)).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None, "a", "b"), (2, [], "a", "b")])).collect() == []
    short = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], "", ""), (2, [3.0, 1.0], "", ""), (3, [9.0], "", "")])).collect()
    assert {r.vec_id for r in short} == {1, 2} and {r.n for r in short} == {2}


def test_deviation_is_exact_and_null_beyond_a_long():
    x = np.array([[10 ** 9, 0], [0, 0]])
    sums = [10 ** 9, 0]
    centre = whitening.Centre.of(sums, 2)
    assert whitening._deviations(x, centre, 2, sums) == [10 ** 18, 10 ** 18]
    x, sums = x * 10, [10 ** 10, 0]
    assert whitening._deviations(x, whitening.Centre.of(sums, 2), 2, sums) == [None, None]


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (9, 4), (40, 40)):
        a = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        v = a @ a.T
        g = whitening.pivoted_cholesky(v)
        assert g.shape[1] <= d and np.allclose(g @ g.T, v, rtol=1e-9, atol=1e-9 * v.max())
        values, units = whitening.principal_components(v)
        assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-10) and (np.diff(values) <= 0).all()
        assert np.allclose(v @ units, units * values, atol=1e-9 * v.max())


# ------------------------------------------------------------------ 13

def brute_trie(rows, lend=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if lend else 0
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def totals(p):
        own = (len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [totals(q) for q in children[p]]
        return sum(b[0] for b in below) + (not below), own + sum(b[1] for b in below)
    out = set()
    for p, m in members.items():
        leaves, saved = totals(p)
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, sha(",".join(map(str, ends)).encode())))
    return out


def trie_rows(df):
    got = df.collect()
    out = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversations(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "n_convs", "name", "part", "words", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_query_13_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(trie.query(spark, SF)) == brute_trie(rows)


def test_trie_of_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_CHUNK", 3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"common words {t}") for c in range(70) for t in range(c % 5)]
    rows += [(7, t, "user", f"turn {t % 3}") for t in range(300, 370)]              # one long conversation
    rows += [(200, None, None, None), (200, 1, "user", ""), (201, 3, "", None), (203, 1, "user", "a\x0bb c  d"), (-5, 0, "user", "common words 0"),
             (-45, 1, "user", "x"), (None, 0, "user", "lost"), (260, 0, "us", "era"), (261, 0, "use", "ra"), (261, 1, "user", " long " * 50_000)]
    for lend in (True, False):
        assert trie_rows(trie.prefix_trie(conversations(spark, rows), lend)) == brute_trie(rows, lend)
    assert trie.prefix_trie(conversations(spark, rows).limit(0), True).collect() == []


def test_repeated_turns_are_turns_of_their_own(spark):
    rows = [(40, 0, "user", "again")] * 5 + [(60, 0, "user", "again")] * 2
    got = trie_rows(trie.prefix_trie(conversations(spark, rows)))
    assert got == brute_trie(rows, False) and max(g[1] for g in got) == 5


def test_heavy_parents_are_sent_and_light_ones_joined(spark, monkeypatch):
    rows = [(c, 0, "user", f"first {c % 4 if c < 150 else 0}") for c in range(300)] + [(c, 1, "user", f"second {c}") for c in range(300)]
    for share in (1, 3, 1000):
        monkeypatch.setattr(trie, "HEAVY_SHARE", share)
        assert trie_rows(trie.prefix_trie(conversations(spark, rows), True)) == brute_trie(rows)


def test_a_conversation_in_many_ranges_keeps_its_order(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(500)] + [(2, 0, "user", "t0")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_rows(trie.prefix_trie(conversations(spark, rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute_trie(rows, False)


# ------------------------------------------------------------------ earlier operators

def test_license_scan_cuts_a_long_line_once(spark):
    """Awkward rows, among them a line of 60,000 words, in the sample and in the scan."""
    docs = awkward(spark).select("doc_id", "text")
    model = licenses.fit(docs)
    licenses.license_paragraphs(docs, model).collect()
    licenses.license_paragraphs(docs.limit(0), model).collect()


def test_license_sample_has_no_words_in_filters(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(licenses, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    licenses.training_rows(awkward(spark).select("doc_id", "text"), 500)
    lines = [x for x in plans[0].split("\n") if "regexp_extract_all" in x]
    assert lines and not any(re.match(r"[\s:+-]*Filter", x) or x.count("regexp_extract_all") > 1 for x in lines)


def _sets(rows):
    import pandas as pd
    return pd.DataFrame(rows, columns=["n", "n_copies", "apart"])


def test_links_of_near_copies_are_derived_and_a_chain_meets_neighbours():
    rng = np.random.default_rng(3)
    # 5,000 near copies of a set of 400: up to 8 shingles apart from the first, D is 42
    near = _sets([(400, 1, rng.choice(10 ** 6, size=rng.integers(0, 9), replace=False)) for _ in range(5000)])
    of_x, of_y, compared = jaccard.verdicts(near, near, 90, True)
    assert compared == 0 and (of_x == 4999).all() and (of_y == 4999).all()
    # a chain: set i has lost i shingles of the first and gained i others
    chain = _sets([(100, 2, np.r_[np.arange(i), 1000 + np.arange(i)]) for i in range(300)])
    of_x, _, compared = jaccard.verdicts(chain, chain, 90, True)
    assert of_x.tolist() == [2 * sum(j != i and 2 * abs(i - j) <= 10 for j in range(300)) for i in range(300)]
    assert compared < 300 * 12


def test_links_of_a_long_chain_of_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 6)
    docs = {i: " ".join(f"w{j}" for j in range(i, i + 40)) for i in range(60)}
    got = jaccard.similarity_links(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 1, 90).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(j != i and 100 * (40 - abs(i - j)) >= 90 * (40 + abs(i - j)) for j in docs) for i in docs}
    assert {r.component_id for r in got} == {0}


def test_groups_are_merged_by_later_links(spark):
    groups = spark.createDataFrame([(1, 1), (4, 1), (7, 7), (9, 7), (20, 20), (21, 20)], "node long, component long")
    links = spark.createDataFrame([(4, 9), (30, 31), (31, 21), (50, 51)], "a long, b long")
    got = {r.node: r.component for r in jaccard._merged(groups, links).collect()}
    assert got == {1: 1, 4: 1, 7: 1, 9: 1, 20: 20, 21: 20, 30: 20, 31: 20, 50: 50, 51: 50}
    assert jaccard._merged(groups, links.limit(0)).count() == 6


def test_pairs_of_one_leader_are_dealt(spark):
    pairs = spark.createDataFrame([(1, b) for b in range(2, 400)] + [(500, 501)], "a long, b long")
    leaders = spark.createDataFrame([(1, "x"), (500, "y"), (9, "z")], "a long, v string")
    out = jaccard._with_leader(pairs, leaders)
    assert sorted((r.a, r.b, r.v) for r in out.collect()) == sorted([(1, b, "x") for b in range(2, 400)] + [(500, 501, "y")])


def test_ftrl_equals_plain_scalar_code():
    s = toxicity.Settings(alpha=0.7, beta=1.3, l1=0.4, l2=0.2)
    model, bias = toxicity.Ftrl(s), 1 << toxicity.BITS
    rng = np.random.default_rng(9)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == bias else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    for _ in range(300):
        places = np.unique(rng.integers(0, 40, size=6))
        label = int(places.min() < 5)
        model.learn(places, label)
        at = [*places.tolist(), bias]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
    at = np.append(np.arange(40), bias)
    assert np.allclose(model.weights(at), [weight(i) for i in at]) and (model.weights(at) == 0).any() and (model.weights(at) != 0).any()


def test_toxicity_learns_from_a_written_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    names = []
    keep = toxicity.written
    try:
        toxicity.written = lambda df, name: names.append(name) or keep(df, name)
        assert toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    finally:
        toxicity.written = keep
    assert names == ["toxicity-features"]
