"""Each operator against brute force, and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import PROSE, SCHEMA, SF, awkward, awkward_rows, base_spans, brute_groups, shingle_set, words  # noqa: E402

from strata.llm import decontaminate, jaccard, licenses, mixing, pii, quality, tokens, toxicity, urls, warc  # noqa: E402


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in table(spark, "documents").collect()}


# ---- op 1

@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, n, percent):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    docs, base = {}, [rng.choices(vocab, k=rng.choice([2, 4, 30, 60])) for _ in range(25)]
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs[i * 3 + 1] = " ".join(w)
    got = jaccard.similarity_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), n, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(docs, n, percent)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingle_set(t, n)) for d, t in docs.items()}
    sets = {d: frozenset(shingle_set(t, n)) for d, t in docs.items()}
    assert {r.doc_id: r.class_id for r in got} == {d: min(e for e in docs if sets[e] == sets[d]) for d in docs}


@pytest.mark.parametrize("n,percent,bucket", [(3, 90, 2048), (5, 80, 7), (1, 60, 5)])
def test_link_numbers_equal_brute_force(spark, monkeypatch, n, percent, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "SALTED", bucket)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    docs, base = {}, [rng.choices(vocab, k=rng.choice([3, 30, 60])) for _ in range(5)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs[i * 3 + 1] = " ".join(w)
    docs[1000] = ""
    got = jaccard.similarity_links(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), n, percent).collect()
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    want = {d: sum(e != d and bool(s) and 100 * len(s & t) >= percent * len(s | t) for e, t in sets.items()) for d, s in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == brute_groups(docs, n, percent)


def test_links_on_awkward_rows(spark):
    got = jaccard.similarity_links(awkward(spark), 3, 90).collect()
    assert sorted(r.n_links for r in got if r.doc_id in (1, 2, 9)) == [4 + (11 in {r.doc_id for r in got if r.component_id == 1})] * 4
    assert {r.doc_id: r.n_links for r in got if r.doc_id in (3, 4, 5, 6)} == dict.fromkeys((3, 4, 5, 6), 0) and len(got) == len(awkward_rows())


def test_groups_on_awkward_rows(spark):
    got = jaccard.similarity_groups(awkward(spark), 3, 90).collect()
    assert len(got) == len(awkward_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert {c for _, c in by[1] + by[2] + by[9]} == {1} and len(by[2]) == 2     # A-Z fold, copies link
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert by[6] == [(1, 6)] and by[7] == [(1, 7)] and by[11] == [(len(shingle_set(awkward_rows()[-1][1], 3)), 1)]
    kept = jaccard.keep_first(awkward(spark), 5, 80)
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 10]


# ---- op 2

def test_licenses_are_found_and_prose_is_not(spark):
    model = licenses.fit(table(spark, "documents"))
    rows = [(1, f"{PROSE}\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License.\n\n" + PROSE), (3, PROSE),
            (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3."), (7, PROSE.replace(".", "\n"))]
    got = licenses.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")), model).collect()
    assert {(r.doc_id, r.paragraph, r.license) for r in got if r.confirmed} == {(1, 1, "apache-2.0"), (2, 0, "mit"), (6, 0, "gpl")}
    assert all(r.probability >= 0.5 and (r.license == "unknown") != r.confirmed for r in got)


def test_license_scan_finds_every_license_line(spark):
    got = {(r.doc_id, r.paragraph) for r in licenses.query(spark, SF).collect() if r.confirmed}
    want = {(d, i) for d, t in texts(spark).items() for i, line in enumerate(t.split("\n")) if re.match(r"(?i)(licensed under|released under|this work is licensed)", line)}
    assert want and want <= got


def test_notice_words_in_ordinary_text_hide_no_notice(spark):
    rows = [(900_001, "All seats were reserved and the rights of the buyers were kept.\nThe rights to the song are all that she kept.\n"
                      "He reserved a table for all of them."), (900_002, f"{PROSE}\nAll rights reserved.")]
    docs = table(spark, "documents").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = licenses.license_paragraphs(docs).filter("doc_id > 900000 and confirmed").collect()
    assert [(r.doc_id, r.paragraph, r.license) for r in got] == [(900_002, 1, "proprietary")]


# ---- op 3

def brute_glob(pattern: str, text: str) -> bool:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.fullmatch(out, text) is not None


def test_automaton_equals_regular_expressions():
    rng = random.Random(2)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", "?"], k=rng.randint(1, 9))) for _ in range(120)]
    globs = [g for g in globs if "***" not in g] + ["**", "*", "a" * 130 + "*"]
    tried = ["".join(rng.choices("ab/", k=rng.randint(0, 12))) for _ in range(300)] + ["", "a" * 131, "a" * 129]
    got = urls.ShiftAnd(globs).matches([t.encode() for t in tried])
    assert got.tolist() == [[brute_glob(g, t) for g in globs] for t in tried]


def test_url_rules(spark):
    rows = [(1, "http://a.net/x"), (2, "https://WWW.Example.NET/en/1"), (3, "http://example.com/de/"), (4, "x://q.org/fr/a?b#c"), (5, "http://net"),
            (6, "http://notexample.com/de/"), (7, None), (8, "no scheme"), (9, "http://spam-farm.org/en"), (10, "http://e.org/" + "a" * 20_000), (1, "http://a.net/x")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(
        spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()]
    assert (1, "a.net", "/x", "net/", "block") in got and got.count((1, "a.net", "/x", "net/", "block")) == 2
    assert (2, "www.example.net", "/en/1", "example.net/en/", "allow") in got and (3, "example.com", "/de/", "example.com/de/", "block") in got
    assert (4, "q.org", "/fr/a", "org/fr/", "allow") in got and (5, "net", "", None, "allow") in got
    assert (6, "notexample.com", "/de/", None, "allow") in got and (7, "", "", None, "allow") in got and (8, "", "", None, "allow") in got
    assert (9, "spam-farm.org", "/en", None, "block") in got


# ---- op 4

def test_archives_round_trip(spark):
    rows = [(1, "http://a.org/x", "same"), (2, "http://b.org/", "same"), (3, None, None), (4, "http://c.org/é?q=1#f", ""), (5, "http://a.org/x", "é" * 40_000),
            (9, "http://a.org/x", "same"), (7, "bad\r\nurl", "other\r\n\r\nWARC/1.1"), (7, "bad\r\nurl", "other\r\n\r\nWARC/1.1"), (None, "http://n.org", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    folder = warc.shared_folder(spark, "warc-test")
    places = warc.write_archives(pages, folder)
    shards = warc.write_index(places, folder, block_lines=2)
    got = warc.read_records(warc.look_up(warc.keys_of(pages), shards, folder), folder).collect()
    assert len(got) == len(rows)
    payloads = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        want = payloads[r.page_id]
        assert r.payload_bytes == len(want) and r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
        assert (bytes(r.payload) == want) if r.record_type == "response" else r.payload is None
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None),
        (7, "response", None), (None, "response", None)}
    one = warc.look_up(spark.createDataFrame([(warc.capture_key("http://b.org/", 2),), ("absent",)], "key string"), shards, folder).collect()
    assert [r.page_id for r in one] == [2]
    small = warc.write_archives(pages, warc.shared_folder(spark, "warc-test"), min_bytes=5)
    assert small.count() == len(rows)


def test_empty_archive(spark):
    pages = table(spark, "pages").limit(0)
    folder = warc.shared_folder(spark, "warc-test")
    shards = warc.write_index(warc.write_archives(pages, folder), folder)
    assert warc.read_records(warc.look_up(warc.keys_of(pages), shards, folder), folder).count() == 0


# ---- op 5

def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    odd = ["".join(rng.choices(["a", "in", "the", " ", "  ", "▁", "\n", "\t", "日", "é", "\x00", "<s>", "0", "😀"], k=rng.choice([0, 1, 3, 40, 900]))) for _ in range(400)]
    rows = list(enumerate([*odd, None, "", "a" * 3000, " " * 400, "ab" * 1500, *(r[1] for r in awkward_rows())]))
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(0)), path).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        (i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows}


def test_token_query_on_documents(spark):
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in tokens.query(spark, SF).collect()} == {d: len(library.encode(t)) for d, t in texts(spark).items()}


# ---- op 6

def test_toxicity_learns_only_from_its_part(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # labels of held-out rows don't matter: turning them changes no score
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b and all(0 <= s <= 1 for s in a.values())
    want = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    pairs = [(a[p] > a[q]) + 0.5 * (a[p] == a[q]) for p in held if want[p] for q in held if not want[q]]
    assert sum(pairs) / len(pairs) > 0.75


def test_toxicity_on_awkward_rows(spark):
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(awkward(spark), labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.toxicity_scores(awkward(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


# ---- op 7

def test_raking_meets_its_targets(spark):
    rng = random.Random(8)
    cells = [(s, l, t, float(rng.randint(1, 900))) for s in "abcd" for l in "xy" for t in "pqr" if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, w double")
    shares = {"source": dict(zip("abcd", (.4, .3, .2, .1))), "lang": {"x": .25, "y": .75}, "topic": dict(zip("pqr", (.5, .3, .2)))}
    targets = {d: mixing.given(df, d, spark.createDataFrame(list(s.items()), f"{d} string, share double")) for d, s in shares.items()}
    raked, error = mixing.rake(df, targets, 1e-8, 200)
    assert error <= 1e-8
    raked = raked.collect()
    total = sum(c[3] for c in cells)
    for d, s in shares.items():
        for v, share in s.items():
            assert sum(r.w for r in raked if r[d] == v) == pytest.approx(share * total, rel=1e-6)
    # the same fit in plain Python
    w = {c[:3]: c[3] for c in cells}
    for _ in range(200):
        for i, d in enumerate(("source", "lang", "topic")):
            for v, share in shares[d].items():
                now = sum(x for k, x in w.items() if k[i] == v)
                w |= {k: x * share * total / now for k, x in w.items() if k[i] == v}
    for r in raked:
        assert r.w == pytest.approx(w[r.source, r.lang, r.topic], rel=1e-5)


def test_sample_has_calibrated_weights(spark):
    docs = table(spark, "documents")
    mix = mixing.Mix()
    got = mixing.mixed(docs, mix).collect()
    assert 0 < len(got) < docs.count() and all(0 < r.mix_probability <= 1 and r.mix_weight > 0 for r in got)
    everything = mixing.mixed(docs, mixing.Mix(rate=1.0)).select("source", (mixing.word_count() * F.col("mix_probability") * F.col("mix_weight")).alias("n")).collect()
    now = {}
    for r in table(spark, "documents").select("source", mixing.word_count().alias("n")).collect():
        now[r.source] = now.get(r.source, 0) + r.n
    assert everything and set(r.source for r in everything) <= set(now)


def test_targets_that_cant_be_met_are_reported(spark):
    shares = lambda d, s: spark.createDataFrame(list(s.items()), f"{d} string, share double")
    wanted = {"source": shares("source", {"a": .9, "b": .1}), "lang": shares("lang", {"x": .1, "y": .9})}
    cells = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 10.0)], "source string, lang string, w double")
    _, error = mixing.rake(cells, wanted, 1e-4, 400)
    assert error > 0.5
    docs = spark.createDataFrame([(k, " ".join([PROSE] * 3), "xy"[k % 2], "ab"[k % 2]) for k in range(20)], "doc_id long, text string, lang string, source string")
    with pytest.raises(mixing.TargetsNotMet) as e:
        mixing.mixed(docs, targets=wanted)
    assert e.value.error == pytest.approx(error, rel=0.1)
    one = {r.mix_error for r in mixing.mixed(docs.filter("source = 'a'"), mixing.Mix(rate=1.0)).collect()}       # one cell
    assert max(one) <= 1e-4
    # a value whose weight another dimension's target takes away counts as missed
    _, lost = mixing.rake(cells, wanted | {"source": shares("source", {"a": 0.0, "b": 1.0})}, 1e-4, 400)
    assert lost >= 1
    # slow marginals are raked to the tolerance: a small cell must take most of the weight
    slow = spark.createDataFrame([("a", "x", 1000.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 1e-3)], "source string, lang string, w double")
    raked, error = mixing.rake(slow, wanted, 1e-6, 400)
    assert error <= 1e-6 and sum(r.w for r in raked.collect() if r.lang == "y") == pytest.approx(0.9 * 1002.001, rel=1e-4)


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mixed(docs, mixing.Mix(rate=0.9))
    assert got.columns == [*docs.columns, "mix_probability", "mix_weight", "mix_error"]
    rows = got.collect()
    assert sum(r.doc_id == 2 for r in rows) in (0, 2)
    assert mixing.mixed(docs.limit(0)).count() == 0


# ---- op 8

def brute_quality(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_equal_brute_force(spark):
    rng = random.Random(6)
    made = [" ".join(rng.choices(["a", "b", "c", "#", "d|", "e\n", "\n", "\x85x"], k=rng.randint(0, 60))) for _ in range(150)]
    rows = list(enumerate([*made, None, "", PROSE, PROSE + "\n" + PROSE]))
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect()
    for r in got:
        want = brute_quality(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_quality_keeps_clean_documents_and_cleans_lines(spark):
    menu = "Home | About | Contact | Imprint | Shop"
    rows = [(1, PROSE, "en", "a", len(PROSE)), (2, f"{menu}\n{PROSE}", "en", "a", 0), (3, "\n".join([menu] * 1 + ["A | b | c | d | e" + str(i) for i in range(20)]) + "\n" + PROSE[:100], "en", "a", 0)]
    got = quality.clean_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in sorted(got)] == [(1, PROSE, len(PROSE)), (2, PROSE, len(PROSE))]
    docs = awkward(spark)
    assert sorted(r.doc_id or 0 for r in quality.clean_documents(docs).select("doc_id").collect()) == [0, 1, 2, 2, 11]     # the long text repeats itself
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    for r in quality.query(spark, SF).collect():
        if r.doc_id in labels and not r.base_failed:
            assert r.kept == bool(labels[r.doc_id])


def test_distinct_share_does_not_fall_with_the_lines_length(spark):
    rng = random.Random(12)
    ranks = range(1, 8001)
    for n in (2_000, 20_000, 100_000):
        line = " ".join(f"w{k}x" for k in rng.choices(ranks, [1 / k for k in ranks], k=n))
        assert quality.judge(line, quality.LineRules())["kept"]
    assert quality.line_fails("", ["buy", "now", "cheap"] * 5_000, 50_000, 0, quality.LineRules()) == "boilerplate"
    assert quality.line_fails("", ["buy", "now", "cheap"] * 7, 70, 0, quality.LineRules()) == "boilerplate"


# ---- op 9

def test_overlaps_are_compared_along_the_whole_diagonal(spark):
    words_ = [f"t{k}" for k in range(2100)]
    changed = [*words_[:1000], *[f"u{k}" for k in range(100)], *words_[1100:]]
    bench = spark.createDataFrame([(7, " ".join(words_)), (8, " ".join(words_[30:60]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{PROSE} {' '.join(changed)} {PROSE}"), (2, " ".join(words_[500:900])), (3, PROSE)], "doc_id long, text string")
    start = len(re.findall(r"\w+", PROSE))
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, r.item_words, r.doc_start) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 7): (2000, 2100, 2100, start), (1, 8): (30, 30, 30, start + 30), (2, 7): (400, 400, 2100, 0)}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(400)]
    items = {i: rng.choices(vocabulary, k=rng.choice([4, 9, 13, 20, 60, 300])) for i in range(25)}
    docs = {}
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = list(items[rng.randrange(25)])
            for k in rng.sample(range(len(w)), int(len(w) * rng.choice([0, 0.1, 0.3]))):
                w[k] = "changed"
            parts += rng.choices(vocabulary, k=rng.randint(0, 40)) + w
        docs[d] = parts + rng.choices(vocabulary, k=rng.randint(0, 40))
    want = {}
    for (d, w), (i, x) in itertools.product(docs.items(), items.items()):
        need = decontaminate.needed(len(x), 12, 0.8)
        for diagonal in range(-len(x) + 1, len(w)):
            lo, hi = max(0, -diagonal), min(len(x), len(w) - diagonal)
            equal = [w[diagonal + j] == x[j] for j in range(lo, hi)]
            if sum(equal) >= need:
                prefix = [0, *itertools.accumulate(equal)]
                most = max((prefix[e] - prefix[b] for b in range(len(equal)) for e in range(b + 1, len(equal) + 1)
                            if prefix[e] - prefix[b] >= 0.8 * (e - b) - 1e-9), default=0)
                if most >= need:
                    want[d, i] = max(want.get((d, i), 0), most)
    frame = lambda t, id_: spark.createDataFrame([(k, " ".join(w)) for k, w in t.items()], f"{id_} long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert set(found) == set(want) and len(want) > 20
    for k, r in found.items():
        here = docs[k[0]][r.doc_start:r.doc_start + r.n_words]
        assert r.item_words == len(items[k[1]]) and r.n_equal <= want[k] and r.n_equal >= 0.8 * r.n_words - 1e-9
        assert any(sum(a == b for a, b in zip(here, items[k[1]][j:j + r.n_words])) == r.n_equal for j in range(r.item_words - r.n_words + 1))


def test_overlaps_find_passages_and_substitutions(spark):
    items = {r.item_id: r.text for r in table(spark, "benchmark").collect()}
    docs = texts(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, SF).collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if plain(x) in plain(t)}
    assert want and want <= got
    long_item = next(x for x in items.values() if len(x.split()) >= 30)
    w = long_item.split()
    swapped = " ".join("changed" if k % 9 == 4 else x for k, x in enumerate(w))
    rows = [(1, f"{PROSE} {swapped} {PROSE}"), (2, PROSE), (3, None), (4, ""), (5, f"short thing here {PROSE}"), (6, long_item.upper()), (6, long_item.upper())]
    bench = spark.createDataFrame([(1, long_item), (2, None), (3, ""), (4, "short thing HERE"), (1, long_item), (None, PROSE)], "item_id long, text string")
    found = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (5, 4), (6, 1)}
    assert decontaminate.overlaps(awkward(spark), bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(awkward(spark), bench).columns == awkward(spark).columns


def test_masks_hit_every_overlap_that_counts():
    def hit(n, changed, shapes):
        equal = "".join("0" if k in changed else "1" for k in range(n))
        return any(all(e >= m for e, m in zip(equal[k:], shape)) for shape, at in shapes
                   for k in (range(n - len(shape) + 1) if at is None else [at]))
    for n, errors in ((12, 0), (13, 1), (14, 2), (15, 3), (20, 4)):
        assert all(hit(n, c, decontaminate.shapes_of(n, 12, 0.8)) for c in itertools.combinations(range(n), errors))
    rng = random.Random(9)
    for n in (25, 30, 40):
        assert all(hit(n, rng.sample(range(n), n // 5), decontaminate.shapes_of(n, 12, 0.8)) for _ in range(3000))
    for n in range(1, 14):
        least = decontaminate.needed(n, 12, 0.8)
        assert all(hit(n, c, decontaminate.shapes_of(n, 12, 0.8)) for c in itertools.combinations(range(n), n - least))


def test_short_items_with_changed_words_are_found(spark):
    changes = {15: [(3, 7, 11), (1, 6, 9), (0, 7, 14)], 12: [(5,), (4, 8), (0, 11)], 5: [(2,), (0,)], 20: [(6, 8, 10, 12)], 25: [(5, 10, 12, 14, 19)]}
    too_many = {15: (2, 5, 8, 11), 12: (3, 6, 9), 5: (1, 3), 20: (3, 7, 11, 14, 16)}
    items = {n: [f"item{n}word{k}" for k in range(n)] for n in changes}
    changed = lambda n, c: f"{PROSE} {' '.join('changed' if k in c else x for k, x in enumerate(items[n]))} {PROSE}"
    rows = [(n * 100 + k, changed(n, c)) for n, cs in changes.items() for k, c in enumerate(cs)]
    wrong = [(n * 100 + 99, changed(n, c)) for n, c in too_many.items()]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = decontaminate.overlaps(spark.createDataFrame(rows + wrong, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 100) for d, _ in rows}
    assert all(r.n_equal >= decontaminate.needed(r.item_words, 12, 0.8) and r.n_equal >= 0.8 * r.n_words - 1e-9 for r in found)


# ---- op 10

def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b@c", "@", ".", "x.y", "1", "22", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+", "+1 (017) 555-7713", "255.1.2.3", "300.1.1.1",
             "(", ")", "\x01", "\x04", "é", "😀", "a@b.co", "%", "_", "\n", "0.0.0.0", "012-34-5678", ". "]
    rows = list(enumerate(["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", "1 " * 3000, "1.2." * 500, "a." * 900 + "@" + "b." * 900 + "c"]))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash"))).collect()
    for r in got:
        base = base_spans(rows[r.doc_id][1])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert set(listed) <= set(r.spans.split(","))


def test_redaction_and_empty_tables(spark):
    docs = awkward(spark).union(awkward(spark).limit(1).withColumn("text", F.lit("Mail to ann@ex.org, +1 (017) 555-7713, 97.51.17.173 or 9807915762804490 now."))
                                .withColumn("doc_id", F.lit(50).cast("long")))
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[50].text == "Mail to <EMAIL>, <PHONE>, <IP> or <CARD> now." and got[50].n_chars == len(got[50].text)
    assert got[1].text == PROSE and got[3].text is None and pii.redacted(docs).columns == docs.columns
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).count() == 0


def test_titled_names_and_long_secrets_are_candidates(spark):
    texts = ["please call Mr Smith tomorrow", "Mrs Jones", "Dr. Özil", "Prof. Émile", "con Señora Ávila", "key " + "0a1b" * 50 + " end",
             "sk-" + "aB3" * 100, "ghp_" + "aB3d" * 80]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start:s.stop]) for s in r.found if pii.KINDS[s.kind] in ("person", "secret")]
           for r in pii.with_spans(rows, "text", "found").collect()}
    assert got == {0: [("person", "Mr Smith")], 1: [("person", "Mrs Jones")], 2: [("person", "Dr. Özil")], 3: [("person", "Prof. Émile")],
                   4: [("person", "Señora Ávila")], 5: [("secret", "0a1b" * 50)], 6: [("secret", texts[6])], 7: [("secret", texts[7])]}


@pytest.mark.parametrize("run", [
    lambda d, s: jaccard.similarity_groups(d, 3, 90), lambda d, s: licenses.license_paragraphs(d), lambda d, s: tokens.token_counts(d, _model()),
    lambda d, s: quality.quality_scores(d), lambda d, s: toxicity.toxicity_scores(d, table(s, "labels"))], ids=["op1", "op2", "op5", "op8", "op6"])
def test_empty_documents(spark, run):
    assert run(table(spark, "documents").limit(0), spark).count() == 0


def _model():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def test_words_helper():
    assert words("Ab\u00a0C d\x0be") == ["ab\u00a0c", "d", "e"]
