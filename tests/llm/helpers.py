"""Brute-force forms and awkward tables that the tests share."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = ("The river rises early in the spring and the old mill near the bridge grinds the grain of all the farms around. "
         "People walk along its banks in the evening, children feed the ducks, and nobody minds the noise of the wheel. "
         "When winter comes the water freezes, the wheel stands still, and the miller mends his tools beside a small fire.")


def awkward_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeats, a very long text, odd characters."""
    long_text = " ".join(f"word{i % 5000} runs" for i in range(30_000))
    return [(1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", len(PROSE)), (3, None, None, None, None), (4, "", "en", "", 0),
            (5, " \t\n", "en", "b", 3), (6, "one", "en", "b", 3), (7, "one two", None, "b", 7), (8, long_text, "en", "c", len(long_text)),
            (9, PROSE.upper(), "en", "c", len(PROSE)), (10, "x\x00\x01\x04y \u00a0z\u2028é😀 a@b.co", "fr", "c", 20), (2, PROSE, "en", "a", len(PROSE)),
            (None, PROSE, "en", "a", len(PROSE)), (11, PROSE.replace("winter", "autumn"), "en", "a", len(PROSE))]


def awkward(spark, extra: bool = True):
    """The rows above, with extra columns whose names clash with results."""
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        for name in ("n_words", "kept", "score", "key", "count", "verdict", "spans", "token", "w", "share", "probability", "found"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text, n):
    w = words(text)
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_groups(docs: dict, n: int, percent: int) -> dict:
    """Smallest id that links reach, by comparing all pairs."""
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    group = {d: d for d in docs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


PII = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text) -> list[tuple]:
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out
