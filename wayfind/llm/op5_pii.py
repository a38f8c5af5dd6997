"""Personal data by weak supervision, in native expressions only.

*Base* spans are those of four patterns (email, ip, card, phone), checked by number ranges,
digit counts and the Luhn sum; they always stay. *Candidates* for more are loose: long
words with digits (keys, passwords, tokens) and capitalised words behind a form of address.
Labelers vote on each candidate: regular expressions of known key forms, a gazetteer of
names of secrets and of given names, and the context in front of the span, its
alphabet and its length. Votes are counted by pattern over all documents (some hundred
rows at most), expectation-maximisation on the driver estimates how reliable each labeler
is, and a logistic classifier over discrete features of the span and its context is fitted
to the expected labels, weighted by counts. Scoring is a sum of literal maps.

Positions come from the pieces between matches, so a text is matched once and split
only where it has a match. Spans are placed, compared and cut by folds in order of their
start, whose cost grows with the number of spans. Patterns are possessive and anchored to the start of a run, so that
they take linear time on long runs and no recursion. Texts are never shuffled: the second
pass matches again rather than move them.

Defined results: null and empty texts have no spans (the digest of nothing). An empty table gives no rows. Spans of
different kinds may overlap, candidates may not overlap base spans or each other: of those that do, the one that starts
first, then a secret, counts. Spans that start together are in the order of their kinds. Repeated rows give equal
rows; a doc_id may be null or shared by different texts. A very long text, or one of very many spans, takes time in
proportion. Other columns are ignored by ``find`` and kept by ``redact``; only names that begin with ``_pii_`` are its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "name")

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
_KEY = "A-Za-z0-9_/+-"
SECRET = rf"(?<![@.{_KEY}])(?=[A-Za-z_/+-]*+[0-9])[{_KEY}]{{12,}}+"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?+ [A-Z][a-z]++(?: [A-Z][a-z]++)?+"
KNOWN_KEYS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[0-9]*[A-F])[0-9A-F]{32,}|xox[abp]-[0-9A-Za-z-]{10,})$"

# fixed values: words that announce a secret, and common given names
SECRET_WORDS = "password passwd pwd passphrase secret token apikey api_key api-key access_key key auth bearer credential credentials pin".split()
GIVEN_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Maria Peter Paul Laura Julia Daniel Marie Pierre Jean Hans Klaus Jose Juan Carlos Carmen Ana Luis Emma Sophie Martin Eva".split()

LABELERS = ("form", "gazetteer", "context", "alphabet", "length")
FEATURES = ("kind", "size", "digits", "letters", "lead", "word")
BEFORE = 24
ROUNDS = 50
# what is held of each labeler before any data: P(-1, 0, 1) given none and given personal data; it
# counts for STRENGTH candidates of each class, whatever the size of the corpus
STRENGTH = 100.0
BELIEF = {
    "form": ((0.18, 0.80, 0.02), (0.02, 0.28, 0.70)),
    "gazetteer": ((0.01, 0.94, 0.05), (0.01, 0.49, 0.50)),
    "context": ((0.60, 0.30, 0.10), (0.25, 0.25, 0.50)),
    "alphabet": ((0.60, 0.10, 0.30), (0.10, 0.10, 0.80)),
    "length": ((0.40, 0.40, 0.20), (0.10, 0.30, 0.60)),
}


SPAN = "struct<start:int,end:int,body:string,before:string,after:string>"
PLACED = "struct<start:int,kind:int,end:int>"
STEP = 256  # elements that a fold appends to one array before it begins the next


def scan(items: str, zero: Column, step: Callable[[Column, Column], Column], down: bool = False) -> Column:
    """The states of a fold over the array column ``items``, one for each element in order (``down``: from the last to the first).

    ``step(state, item)`` is the next state. Appending copies, so states go to arrays of ``STEP`` that
    begin with the state before them, and these to an array of arrays: the cost grows with
    the items, not with their square. ``items`` is a column of its own, so it is computed once.
    """
    n = F.size(items)

    def part(parts: Column, j: Column) -> Column:
        lo, hi = j * STEP + 1, F.least((j + 1) * STEP, n)
        spots = F.sequence(n + 1 - lo, n + 1 - hi, F.lit(-1)) if down else F.sequence(lo, hi)
        begin = F.array(F.element_at(F.element_at(parts, -1), -1))
        return F.array_append(parts, F.aggregate(spots, begin, lambda states, i: F.array_append(states, step(F.element_at(states, -1), F.element_at(items, i)))))

    parts = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), F.array(F.array(zero)), part)
    return F.when(n > 0, F.flatten(F.transform(F.slice(parts, 2, n), lambda p: F.slice(p, 2, n))))


def beside(column: str, value: Column) -> Column:
    """``value``, which reads ``column`` in a lambda: a second reference keeps the planner from computing the column there, for each element."""
    return F.when(F.coalesce(F.size(column), F.lit(0)) >= 0, value)


def fenced(value: Column) -> Column:
    """The value itself; filters on the results stay above it instead of being pushed, column by column, into copies of all folds."""
    return F.when(F.rand(0) >= 0, value)


def located(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Adds ``_pii_<kind>`` for each kind's pattern: all matches in order, as structs of start, end (code points), body, before (the characters in front) and after.

    Where a text must hold some character to match, it is looked for first.
    """
    none = F.array().cast("array<string>")
    m, p, gaps, ends = ({k: f"_pii_{name}_{k}" for k in patterns} for name in ("m", "p", "g", "e"))

    def found(pattern: str, needs: str | None) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.when(F.contains(F.col(text), F.lit(needs)), every).otherwise(none) if needs else every

    def spans(k: str) -> Column:
        end = lambda i: F.element_at(ends[k], i + 1)
        each = F.transform(m[k], lambda x, i: F.struct(
            (end(i) - F.length(x)).alias("start"), end(i).alias("end"), x.alias("body"),
            F.right(F.element_at(p[k], i + 1), F.lit(BEFORE)).alias("before"), F.left(F.element_at(p[k], i + 2), F.lit(1)).alias("after"),
        ))
        return F.when(F.size(m[k]) > 0, each).otherwise(F.array().cast(f"array<{SPAN}>"))

    sizes = lambda k: F.transform(m[k], lambda x, i: F.length(F.element_at(p[k], i + 1)) + F.length(x))
    df = df.withColumns({m[k]: found(*of) for k, of in patterns.items()})
    df = df.withColumns({p[k]: F.when(F.size(m[k]) > 0, F.split(F.col(text), of[0], -1)) for k, of in patterns.items()})
    df = df.withColumns({gaps[k]: F.when(F.size(m[k]) > 0, sizes(k)) for k in patterns})
    df = df.withColumns({ends[k]: scan(gaps[k], F.lit(0), lambda at, x: at + x) for k in patterns})
    return df.withColumns({f"_pii_{k}": spans(k) for k in patterns}).drop(*m.values(), *p.values(), *gaps.values(), *ends.values())


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _sound(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": body.rlike(IP_PARTS),
        "card": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]


ASKED = "struct<start:int,kind:int,end:int,body:string,before:string,after:string>"


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_pii_base`` (sorted structs of start, kind, end) and ``_pii_more`` (candidates)."""
    out = docs.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    out = located(out, "_pii_text", {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+"), "secret": (SECRET, None), "name": (NAME, None)})

    def placed(i: int, kind: str) -> Column:
        kept = F.filter(F.col(f"_pii_{kind}"), lambda s: _sound(kind, s["body"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    out = out.withColumn("_pii_base", F.sort_array(F.concat(*(placed(i, k) for i, k in enumerate(KINDS[:4])))))

    def asked(i: int, kind: str) -> Column:
        return F.transform(F.col(f"_pii_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["body"].alias("body"), s["before"].alias("before"), s["after"].alias("after")))

    # candidates that a base span overlaps go: one sweep up with the end of the base so far, one down with its next start
    text = F.lit(None).cast("string")
    plain = F.transform("_pii_base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), text.alias("body"), text.alias("before"), text.alias("after")))
    more = F.size("_pii_secret") + F.size("_pii_name") > 0
    out = out.withColumn("_pii_all", F.when(more, F.sort_array(F.concat(plain, asked(4, "secret"), asked(5, "name")))).otherwise(F.array().cast(f"array<{ASKED}>")))
    base = lambda s: s["kind"] < 4
    up = scan("_pii_all", F.struct(F.lit(-1).alias("edge"), F.lit(False).alias("hit")), lambda a, s: F.struct(F.when(base(s), F.greatest(a["edge"], s["end"])).otherwise(a["edge"]).alias("edge"), (s["start"] < a["edge"]).alias("hit")))
    down = scan("_pii_all", F.struct(F.lit(2**31 - 1).alias("edge"), F.lit(False).alias("hit")), lambda a, s: F.struct(F.when(base(s), s["start"]).otherwise(a["edge"]).alias("edge"), (a["edge"] < s["end"]).alias("hit")), down=True)
    out = out.withColumns({"_pii_up": up, "_pii_down": down})
    free = F.filter("_pii_all", lambda s, i: ~base(s) & ~F.element_at("_pii_up", i + 1)["hit"] & ~F.element_at("_pii_down", F.size("_pii_all") - i)["hit"])
    return out.withColumn("_pii_more", beside("_pii_up", beside("_pii_down", free))).drop("_pii_text", "_pii_all", "_pii_up", "_pii_down", *(f"_pii_{k}" for k in KINDS))


def votes(s: Column) -> list[Column]:
    """One of -1, 0 (no opinion) and 1 for each labeler."""
    body, secret = s["body"], s["kind"] == 4
    word = _announced(s["before"])
    given = F.split(body, " ")
    form = F.when(body.rlike(KNOWN_KEYS), 1).when(secret, 0).otherwise(F.when(F.size(given) > 2, 1).otherwise(0))
    gazetteer = F.when(secret, F.when(word, 1).otherwise(0)).otherwise(F.when(F.element_at(given, 2).isin(GIVEN_NAMES), 1).otherwise(0))
    context = F.when(secret, F.when(s["before"].rlike("[=:] ?[\"']?$"), 1).when(s["before"].rlike("[a-z] $"), -1).otherwise(0)).otherwise(F.when(s["after"].isin(".", ",", "", " "), 1).otherwise(0))
    both = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    alphabet = F.when(secret, F.when(both & ~body.rlike("[/+-].*[/+-]"), 1).otherwise(-1)).otherwise(0)
    length = F.when(secret, F.when(F.length(body) >= 16, 1).when(F.length(body) < 14, -1).otherwise(0)).otherwise(0)
    return [v.cast("int") for v in (form, gazetteer, context, alphabet, length)]


def _announced(before: Column) -> Column:
    return F.lower(before).rlike(f"(?<![a-z])(?:{'|'.join(SECRET_WORDS)})[\\s\"']*[=: ]+[\"']?$")


def traits(s: Column) -> list[Column]:
    """A discrete value for each feature."""
    body, n = s["body"], F.length(s["body"])
    share = F.length(F.regexp_replace(body, "[^0-9]", "")) / n
    case = F.concat(F.when(body.rlike("[A-Z]"), "A").otherwise(""), F.when(body.rlike("[a-z]"), "a").otherwise(""), F.when(body.rlike("[_/+-]"), "_").otherwise(""))
    lead = F.regexp_extract(s["before"], "([=:\"' ])$", 1)
    return [s["kind"].cast("string"), F.least(F.floor(n / 4), F.lit(8)).cast("string"), F.floor(share * 4).cast("string"), case, lead, _announced(s["before"]).cast("string")]


@dataclass
class Model:
    reliability: dict[str, tuple[float, float]]  # of each labeler: votes for, given personal data and given none
    weights: list[dict[str, float]]  # by feature
    bias: float


def expect(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of vote patterns, and P(vote | label) by labeler, label and vote + 1."""
    belief = np.array([BELIEF[name] for name in LABELERS[: patterns.shape[1]]])
    table, prior, strength = belief.copy(), np.array([0.5, 0.5]), STRENGTH
    for _ in range(ROUNDS):
        logs = np.log(prior)[:, None] + sum(np.log(table[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        both = np.stack([counts * (1 - p), counts * p])
        for j in range(patterns.shape[1]):
            seen = np.stack([both[:, patterns[:, j] == v].sum(axis=1) for v in (-1, 0, 1)], axis=1)
            table[j] = seen + strength * belief[j]
            table[j] /= table[j].sum(axis=1, keepdims=True)
        prior = (both.sum(axis=1) + 0.1 * strength) / (counts.sum() + 0.2 * strength)
    return p, table


def fit(annotated: DataFrame) -> Model | None:
    """Votes and features of all candidates, counted by pattern: the rows that reach the driver don't grow with the input."""
    # an inner explode would push a filter on the candidates through all the columns that make them
    one = annotated.select(F.explode_outer("_pii_more").alias("s")).where("s is not null")
    names = [f"v{i}" for i in range(len(LABELERS))] + [f"f{i}" for i in range(len(FEATURES))]
    columns = [c.alias(n) for c, n in zip([*votes(F.col("s")), *traits(F.col("s"))], names, strict=True)]
    rows = one.select(*columns).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    if not rows:
        return None
    patterns, counts = np.array([[r[n] for n in names[: len(LABELERS)]] for r in rows]), np.array([r["n"] for r in rows], float)
    p, table = expect(patterns, counts)
    values = [sorted({r[n] for r in rows}) for n in names[len(LABELERS) :]]
    spots = [{v: i for i, v in enumerate(vs)} for vs in values]
    ends = np.cumsum([0, *map(len, values)])
    x = np.zeros((len(rows), ends[-1] + 1))
    for i, r in enumerate(rows):
        x[i, [ends[j] + spots[j][r[n]] for j, n in enumerate(names[len(LABELERS) :])]] = 1
    x[:, -1] = 1
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(60):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-3 * np.eye(len(w))
        w += np.linalg.solve((x * (share * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + ridge, x.T @ (share * (p - q)) - 1e-3 * w)
    weights = [{v: float(w[ends[j] + i]) for v, i in spot.items()} for j, spot in enumerate(spots)]
    return Model({name: (float(table[j, 1, 2]), float(table[j, 0, 2])) for j, name in enumerate(LABELERS)}, weights, float(w[-1]))


def accepted(annotated: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``_pii_spans``: the base and the candidates that the classifier takes, of overlapping ones the first."""
    if model is None:
        return annotated.withColumn("_pii_spans", F.col("_pii_base"))

    def good(s: Column) -> Column:
        total = F.lit(model.bias)
        for value, weights in zip(traits(s), model.weights, strict=True):
            table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
            total = total + F.coalesce(F.try_element_at(table, value), F.lit(0.0))
        return total >= 0

    out = annotated.withColumn("_pii_good", F.sort_array(F.transform(F.filter("_pii_more", good), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    out = out.withColumn("_pii_kept", scan("_pii_good", F.struct(F.lit(-1).alias("edge"), F.lit(True).alias("free")), lambda a, s: F.struct(F.greatest(a["edge"], F.when(s["start"] >= a["edge"], s["end"]).otherwise(a["edge"])).alias("edge"), (s["start"] >= a["edge"]).alias("free"))))
    kept = F.filter("_pii_good", lambda s, i: F.element_at("_pii_kept", i + 1)["free"])
    return out.withColumn("_pii_spans", F.sort_array(F.concat("_pii_base", beside("_pii_kept", kept)))).drop("_pii_good", "_pii_kept")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("_pii_base", lambda s: s["kind"] == kind))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Base counts and digest, and all spans, of each document."""
    annotated = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    model = model or fit(annotated)
    out = accepted(annotated, model)
    counts = [_count(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_pii_base")), 256).alias("base_sha256"), fenced(joined(F.col("_pii_spans"))).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with [KIND] in place of each span; of overlapping spans the first, drawn out to the end of all."""
    annotated = annotate(docs, text)
    out = accepted(annotated, fit(annotated)).drop("_pii_base", "_pii_more")
    marks, t = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.col(text)
    # a span that begins before the end of those in front adds nothing but its end; `front` is where the text goes on before a span
    begin = F.struct(F.lit(0).alias("edge"), F.lit(0).alias("front"), F.lit(True).alias("free"))
    out = out.withColumn("_pii_edges", scan("_pii_spans", begin, lambda a, s: F.struct(F.greatest(a["edge"], s["end"]).alias("edge"), a["edge"].alias("front"), (s["start"] >= a["edge"]).alias("free"))))
    each = F.transform("_pii_spans", lambda s, i: F.struct(F.element_at("_pii_edges", i + 1)["front"].alias("front"), s["start"].alias("start"), s["kind"].alias("kind"), F.element_at("_pii_edges", i + 1)["free"].alias("free")))
    out = out.withColumn("_pii_cuts", F.when(F.size("_pii_spans") > 0, F.filter(each, lambda s: s["free"])))
    # cutting counts from the front of a text, so each run of STEP spans is cut from its own stretch
    n, at = F.size("_pii_cuts"), lambda i: F.element_at("_pii_cuts", i)
    stretch = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda j: F.substring(t, at(j * STEP + 1)["front"] + 1, at(F.least((j + 1) * STEP, n))["start"] - at(j * STEP + 1)["front"]))
    out = out.withColumn("_pii_parts", F.when(n > 0, stretch))
    run = lambda i: F.floor(i / STEP).cast("int")
    piece = lambda s, i: F.concat(F.substring(F.element_at("_pii_parts", run(i) + 1), s["front"] - at(run(i) * STEP + 1)["front"] + 1, s["start"] - s["front"]), F.element_at(marks, s["kind"] + 1))
    rest = F.substring(t, F.element_at("_pii_edges", -1)["edge"] + 1, F.length(t))
    new = F.concat(F.array_join(beside("_pii_parts", F.transform("_pii_cuts", piece)), ""), rest)
    return out.withColumn(text, fenced(F.when(n > 0, new).otherwise(t))).drop("_pii_spans", "_pii_edges", "_pii_cuts", "_pii_parts")
