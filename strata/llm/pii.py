"""Personal data by weak supervision, with DataFrame functions only.

Base rules find emails, IPv4 addresses, card numbers and phone numbers; they
are always reported.  Beyond them, wider patterns propose candidate spans
(national phone numbers, numbers that fail a base rule, social security
numbers, IBANs, secrets, titled names).  Five labelers vote on every span,
base or not: its format, a gazetteer, its context, its digits or characters,
and its bounds.  Expectation-maximisation estimates each labeler's reliability
and each kind's share of true spans from the counts of vote patterns, without
any label; its posterior weights train a logistic regression, the final span
classifier, whose positive candidates are added.  Beside the votes it reads the
span itself, per kind: its length, its classes of characters and how many differ,
its shape, the characters at its sides and the words before and after it, hashed
to ``CUE_SLOTS`` places.

The vote patterns are at most kinds x 3^5, whatever the data.  The classifier
learns from the counts of all spans of all documents, grouped by votes and cues
before they are shuffled and written as a table, not from a sample.

Regular expressions are written so that Java matches them in linear time and
without recursion: a separator between two fitting characters is first turned
into a joiner, so that a run is one character class.

Cases: a null text counts as empty (no spans; the digest of the empty string).
Texts of any length are searched whole; positions count code points.  Repeated
rows are all returned and all counted in the fit; an empty table gives no rows;
other columns are not read, or pass through ``redacted`` untouched.  A span
the classifier adds never overlaps a base span; of two overlapping ones the
earlier kind in the list stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, text_or_empty, written
from strata.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "person")
BASE = KINDS[:4]
LABELERS = ("format", "gazetteer", "context", "content", "bounds")

_OPEN, _CLOSE, _STAND_IN, _SPACE, _HYPHEN, _DOT = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"

# What the gazetteer knows.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "eu", "de", "fr", "es", "it",
               "nl", "uk", "us", "ca", "ch", "at", "be", "pl", "pt", "se", "no", "dk", "fi", "ru", "jp", "cn", "in", "br", "mx", "au")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
                 "91", "92", "93", "94", "95", "98")
IBAN_COUNTRIES = ("AD", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS",
                  "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM")
CUES = {
    "email": "mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|login from", "card": "card|visa|master|amex|credit|debit|pan",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|sms", "ssn": "ssn|social security|tax id", "iban": "iban|account|konto|cuenta|compte",
    "secret": "token|secret|key|password|passwd|credential|bearer", "person": "name|contact|signed|dear|sincerely|patient|client",
}
CUE_SLOTS = 1 << 10     # places of the span's own cues among the classifier's inputs
WORD_CLASSES = 64       # hashed classes of the words beside a span
AGAINST = r"version|isbn|figure|section|chapter|checksum|commit|digest|serial|order no"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(m: Column) -> Column:
    return F.regexp_extract_all(m, F.lit("(?s)."), F.lit(0))


def _luhn(m: Column) -> Column:
    """The digits pass the mod-10 check."""
    return F.aggregate(
        F.transform(_chars(F.reverse(_digits(m))), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))),
        F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(m: Column) -> Column:
    """All parts are at most 255, however many digits they have."""
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")), F.lit("")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _plain(text: Column) -> Column:
    """The text without the marks used below; same length, same matches."""
    marks = "".join((_OPEN, _CLOSE, _SPACE, _HYPHEN, _DOT))
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, _STAND_IN * len(marks))).otherwise(text)


def _numbers(text: Column) -> Column:
    """Single spaces and hyphens between digits become joiners."""
    spaced = F.regexp_replace(text, "(?<=[0-9])\x20(?=[0-9])", _SPACE)
    return F.regexp_replace(spaced, "(?<=[0-9])-(?=[0-9])", _HYPHEN)


def _names(text: Column) -> Column:
    """Dots between characters of host names become joiners."""
    return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)


_LOCAL = f"[A-Za-z0-9._%+{_DOT}-]"
# (kind, is a base rule, what every match contains, preparation, pattern)
_SEARCHES: tuple[tuple[str, bool, str, Callable[[Column], Column], str], ...] = (
    ("email", True, "@", _names, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"),
    ("ip", True, r"[0-9]\.[0-9]", lambda t: t, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "[0-9]", _numbers, f"[0-9][0-9{_SPACE}{_HYPHEN}]++"),
    ("phone", True, r"\+[0-9]", lambda t: t, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", False, "[0-9]{3}[ .-][0-9]{4}", lambda t: t,
     r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    ("ssn", False, "[0-9]-[0-9]", lambda t: t, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", False, "[A-Z]{2}[0-9]{2}", lambda t: t,
     r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", False, "[A-Za-z0-9]{20}", lambda t: t,
     r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9_])"),
    ("person", False, r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.? \p{Lu}", lambda t: t,
     r"(?<![\p{L}0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})?"),
)


def _base_holds(kind: str, m: Column) -> Column:
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "ip":
        return _octets(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _proposed(kind: str, m: Column) -> Column:
    """Matches of a base pattern that stay as candidates though the rule fails."""
    return F.length(_digits(m)).between(13, 19) if kind == "card" else F.lit(True)


_FOUND = "array<struct<start:int,stop:int,m:string,base:boolean,left:string,beside:string,right:string>>"


def _matches(text: Column, kind: str, base: bool, hint: str, prepared: Callable[[Column], Column], pattern: str) -> Column:
    """Spans of one pattern, by start.

    Matches are set off with marks; the pieces between the marks give the
    positions, as all preparation keeps lengths.
    """
    marked = F.split(F.regexp_replace(prepared(text), f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def span(two: Column, at: Column) -> Column:
        piece, before = two["piece"], two["before"]
        m, start = F.substring_index(piece, _CLOSE, 1), at.cast("int")
        beside = F.concat(F.substring(before, -1, 1), F.lit(" "), piece.substr(F.length(m) + 2, F.lit(1)))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("m"),
                        (_base_holds(kind, m) if base else F.lit(False)).alias("base"),
                        F.lower(F.substring(before, -40, 40)).alias("left"), beside.alias("beside"),
                        F.lower(piece.substr(F.length(m) + 2, F.lit(40))).alias("right"))

    def located(pieces: Column) -> Column:
        # starts gather in a string, which grows by plain copies; each piece but the first lost a mark
        starts = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece) - F.when(acc["out"] == "", F.lit(0)).otherwise(F.lit(1))).alias("at"),
            F.concat(acc["out"], (acc["at"] + F.length(piece) - F.when(acc["out"] == "", F.lit(0)).otherwise(F.lit(1))).cast("string"),
                     F.lit(",")).alias("out")))["out"]
        two = F.zip_with(F.slice(pieces, 2, F.size(pieces)), F.slice(pieces, 1, F.size(pieces) - 1),
                         lambda piece, before: F.struct(piece.alias("piece"), before.alias("before")))
        found = F.zip_with(two, F.slice(F.split(starts, ","), 1, F.size(pieces) - 1), span)
        return F.filter(found, lambda s: s["base"] | _proposed(kind, s["m"])) if base else found

    none = F.array().cast(_FOUND)
    return F.when(text.rlike(hint), _with(marked, located)).otherwise(none)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, s: Column) -> Column:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    m, left, beside, digits = s["m"], s["left"], s["beside"], _digits(s["m"])
    strict = {"email": s["base"], "ip": s["base"], "card": s["base"], "phone": s["base"] | m.rlike(r"^\(?[0-9]{3}"),
              "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "iban": F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
              "secret": ~m.rlike("^[0-9]+$"), "person": m.rlike(r"\. ")}[kind]
    known = {"email": F.lower(F.substring_index(F.replace(m, F.lit(_DOT), F.lit(".")), ".", -1)).isin(*TOP_DOMAINS),
             "ip": ~m.rlike(r"^(?:0|255)\."), "card": digits.rlike("^[3-6]"),
             "phone": digits.rlike("^(?:" + "|".join(CALLING_CODES) + ")"), "ssn": ~digits.rlike("^(?:123456789|078051120)$"),
             "iban": m.substr(1, 2).isin(*IBAN_COUNTRIES), "secret": m.rlike("^(?:AKIA|gh[pousr]_|sk-)") | (F.length(m) % 8 == 0),
             "person": m.rlike("^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)")}[kind]
    chars = F.size(F.array_distinct(_chars(m)))
    return F.array(_vote(strict, ~strict), _vote(known, ~known), _vote(left.rlike(CUES[kind]), left.rlike(AGAINST)),
                   _vote(chars >= 5, chars <= 3), _vote(~beside.rlike(r"[\p{L}0-9_]"), beside.rlike("[0-9_]")))


def _cues(kind: str, s: Column) -> Column:
    """Places of the span's own cues: length, characters, shape, sides and neighbouring words."""
    m = s["m"]
    has = F.concat(*[F.when(m.rlike(c), F.lit(n)).otherwise(F.lit("")) for c, n in (("[0-9]", "9"), (r"\p{Lu}", "A"), (r"\p{Ll}", "a"))])
    runs = F.regexp_replace(F.regexp_replace(m, r"\p{L}+", "a"), "[0-9]+", "9")
    shape = F.regexp_replace(runs, "(?:9a|a9)[9a]*", "x")
    sides = F.regexp_replace(F.regexp_replace(F.lower(s["beside"]), r"\p{L}", "a"), "[0-9]", "9")
    # only words that have ended within what is read beside the span
    before = F.regexp_extract(s["left"], r"[^\p{L}](\p{L}+)[^\p{L}]*$", 1)
    after = F.regexp_extract(s["right"], r"^[^\p{L}]*(\p{L}+)[^\p{L}]", 1)
    words = [F.when(w == "", F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(w), F.lit(WORD_CLASSES))).cast("string") for w in (before, after)]
    values = (F.floor(F.log2(F.length(m))).cast("string"), has, F.floor(F.log2(F.size(F.array_distinct(_chars(m))))).cast("string"),
              shape, sides, *words)
    return F.array(*[F.pmod(F.xxhash64(F.lit(kind), F.lit(i), v), F.lit(CUE_SLOTS)).cast("int") for i, v in enumerate(values)])


def with_spans(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``kind, start, stop, base, votes, cues`` of all base spans and candidates."""
    plain = f"{name}_plain"
    parts = [F.transform(_matches(F.col(plain), kind, base, *search), _voted(kind)) for kind, base, *search in _SEARCHES]
    return docs.withColumn(plain, _plain(text_or_empty(text_col))).withColumn(name, F.concat(*parts)).drop(plain)


def _voted(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                              s["base"].alias("base"), _votes(kind, s).alias("votes"), _cues(kind, s).alias("cues"))


def estimate(patterns: list[tuple[int, tuple, float]], rounds: int = 50) -> list[float]:
    """Posterior of each (kind, votes, count) pattern by expectation-maximisation.

    A labeler has a table of P(vote | true span) and P(vote | other); each kind
    has its share of true spans.  Both are smoothed and start from votes that
    are somewhat better than chance.
    """
    share = dict.fromkeys({k for k, _, _ in patterns}, 0.5)
    says = [{y: {v: 0.6 if v == y else 0.2 for v in (-1, 0, 1)} for y in (1, -1)} for _ in LABELERS]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(t[1][v] / t[-1][v]) for t, v in zip(says, votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for kind in share:
            n = sum(c for k, _, c in patterns if k == kind)
            share[kind] = (sum(p * c for (k, _, c), p in zip(patterns, post) if k == kind) + 1) / (n + 2)
        for i, table in enumerate(says):
            for y in (1, -1):
                # the pseudo-counts keep a labeler from turning against its own votes
                mass = {v: 6.0 if v == y else 2.0 for v in (-1, 0, 1)}
                for (_, votes, c), p in zip(patterns, post):
                    mass[votes[i]] += c * (p if y == 1 else 1 - p)
                table[y] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return post


def _places(kind: Column, votes: Column, cues: Column) -> Column:
    """Places of the classifier's inputs that are 1: kind, each labeler's vote, then the cues; the rest is 0."""
    said = F.transform(votes, lambda v, i: len(KINDS) + 2 * i + F.when(v == 1, F.lit(0)).when(v == -1, F.lit(1)))
    return F.array_distinct(F.concat(F.array(kind), F.filter(said, lambda p: p.isNotNull()),
                                     F.transform(cues, lambda c: c + len(KINDS) + 2 * len(LABELERS))))


INPUTS = len(KINDS) + 2 * len(LABELERS) + CUE_SLOTS


def span_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, votes, cues, n``: how often each occurs among all spans of all documents."""
    spans = with_spans(docs.select(F.col(text_col)), text_col, "__s").select(F.explode("__s").alias("s"))
    return spans.groupBy("s.kind", "s.votes", "s.cues").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """Coefficients of the span classifier, the intercept last; None without any span."""
    ensure_checkpoint_dir(docs.sparkSession)
    counted = written(span_counts(docs, text_col), "span-counts")
    voted = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    patterns = sorted((r.kind, tuple(r.votes), float(r.n)) for r in voted.collect())    # at most kinds x 3^labelers rows
    if not patterns:
        return None
    said = lambda k, v: ",".join(map(str, (k, *v)))
    known = F.create_map(*[F.lit(x) for (k, v, _), p in zip(patterns, estimate(patterns)) for x in (said(k, v), p)])
    true = known[F.concat_ws(",", F.col("kind").cast("string"), F.col("votes").cast("array<string>"))]
    both = counted.select(_places(F.col("kind"), F.col("votes"), F.col("cues")).alias("places"), "n", true.alias("true"))
    both = both.select("places", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("true")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("true"))).alias("weight")))).alias("y"))
    table = both.select(F.transform("places", lambda p: p.cast("string")).alias("places"), "y.label", F.greatest("y.weight", F.lit(1e-6)).alias("weight"))
    table = CountVectorizerModel.from_vocabulary([str(i) for i in range(INPUTS)], "places", "features", minTF=0.0).transform(table)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=40, standardization=False).fit(table.select("features", "label", "weight"))
    return [*map(float, model.coefficients), float(model.intercept)]


def accepted(found: Column, model: list[float] | None) -> Column:
    """Base spans, and candidates that the classifier takes and no earlier span overlaps."""
    base = F.filter(found, lambda s: s["base"])
    if model is None:
        return base
    weights = F.lit(model[:-1])
    logit = lambda s: F.aggregate(_places(s["kind"], s["votes"], s["cues"]), F.lit(model[-1]),
                                  lambda a, p: a + F.element_at(weights, p + 1))
    more = F.filter(found, lambda s: ~s["base"] & (logit(s) >= 0))
    return F.when(F.size(more) == 0, base).otherwise(F.aggregate(more, base, lambda kept, s: F.when(
        F.exists(kept, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])), kept).otherwise(F.concat(kept, F.array(s)))))


def _listed(found: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, per document."""
    model = fit(docs, text_col)
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "found")
    base = F.filter("found", lambda s: s["base"])
    return found.select(
        "doc_id", *[_count(base, k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(accepted(F.col("found"), model)).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; same columns.

    Spans that overlap or touch go together, under the first one's kind.
    """
    model = fit(docs, text_col)
    found = with_spans(docs, text_col, "__found").withColumn("__spans", F.array_sort(F.transform(
        accepted(F.col("__found"), model), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))))

    def step(acc: Column, s: Column) -> Column:
        inside = (s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0) & (F.size(acc["out"]) > 0))
        tag = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit(">"))
        before = F.col(text_col).substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(before, tag))).alias("out"))

    cut = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    rest = F.concat(cut["out"], F.array(F.col(text_col).substr(cut["at"] + 1, F.length(text_col))))
    clean = F.when(F.size("__spans") > 0, F.array_join(rest, "")).otherwise(F.col(text_col))
    out = found.withColumn(text_col, clean)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.size("__spans") > 0, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
                             .otherwise(F.col(chars_col)))
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(documents(spark, sf_dir))
