"""Personal data with a semi-Markov conditional random field.

Candidate segments are scored whole: by their shape, digits, checksums, separators and the words before them. A
bounded-entity dynamic program chooses boundaries and kinds jointly (no entity is longer than `LONGEST`
tokens, so it is linear in the text). The weights are learned here by maximising the conditional likelihood of a
generated, seeded set of sentences with personal data in many spellings and with numbers that look like it.

A candidate touches a seed: an @, a bracketed "at" or "dot", or a number with its separators of nine characters or more; shorter
numbers and an unbracketed "at" start none, by the field's definition. So away from seeds only `nothing` is possible, and the program
falls apart into stretches of `LONGEST` tokens around them, with the same result as over the whole text.

Four exact rules give base spans (an email, an IPv4 address, a card number with its checksum, an international
phone number); those always stay. The field decodes what lies between them, each gap by itself.

Defined results: null and empty texts have no spans; each row of a repeated id is judged by itself; an empty
table gives no rows; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, narrow, pieces, texts, trimmed

KINDS = ("email", "ip", "card", "phone")
LONGEST = 14

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact rules, ordered by kind, then start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:  # a run of local characters up to an @ begins where it can, so only @ need be visited
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the field ----

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
SEED = re.compile(r"\d[\d\x20().-]{7,}\d|@|[\[({<]\s?(?:at|dot)\s?[\])}>]", re.I)
# Words that announce a kind.
ANNOUNCE = {
    **dict.fromkeys(("email", "mail", "mailto", "courriel", "correo"), "email"), **dict.fromkeys(("ip", "host", "server", "address", "adresse"), "ip"),
    **dict.fromkeys(("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), "card"), **dict.fromkeys(("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono"), "phone"),
    **dict.fromkeys(("isbn", "version", "order", "invoice", "id", "no", "nr", "ref", "doi", "issn", "total"), "number"),
}


def tokens(text: str, start: int, stop: int) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in TOKEN.finditer(text, start, stop)]


def _features(text: str, toks: list[tuple[str, int, int]], i: int, j: int) -> list[str]:
    """Of the segment of tokens i to j, as a whole."""
    a, b = toks[i][1], toks[j][2]
    s, words = text[a:b], [t[0].lower() for t in toks[i : j + 1]]
    digits = _digits(s)
    n = len(digits)
    groups = "-".join(str(min(len(w), 7)) for w in words if w.isdigit())
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: str(min(len(m[0]), 9)), s))[:20]
    prior = toks[i - 1][0].lower() if i else ""
    further = toks[i - 2][0].lower() if i > 1 else ""
    out = [f"shape={shape}", f"groups={groups}", f"n={n if n < 20 else 20}", f"letters={any(w.isalpha() for w in words)}", f"first={'9' if words[0].isdigit() else 'a' if words[0].isalpha() else words[0]}", f"last={'9' if words[-1].isdigit() else 'a' if words[-1].isalpha() else words[-1]}"]
    out.append(f"before={ANNOUNCE.get(prior) or ANNOUNCE.get(further)}")
    spelled = " ".join(words)
    signs = "@" in s or bool(re.search(r"[\[({<] ?at ?[\])}>]", spelled))
    if signs:
        dots = bool(re.search(r"[a-z0-9] ?(?:\.|[\[({<] ?dot ?[\])}>]|dot) ?[a-z]{2,6}$", spelled))
        out.append(f"address={s.count('@') <= 1 and dots and spelled[:1].isalnum()}")
        glued = text[a - 1 : a]
        out.append(f"cut={glued.isalnum() or (bool(glued) and glued in '._-+')}")
        out.append(f"white={bool(re.search(r'\s', re.sub(r'\s*(?:[\[({<]\s?(?:at|dot)\s?[\])}>]|@)\s*', '', s, flags=re.I)))}")
    if 13 <= n <= 19:
        out.append(f"luhn={luhn(digits)}:{bool(re.fullmatch(r'[\d .-]+', s))}")
    parts = re.split(r"\s*\.\s*", s)
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append(f"quad={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if 9 <= n <= 15 and not any(w.isalpha() for w in words):
        out.append(f"dial={s[0] in '+('}:{bool(re.search(r'[ ().-]', s))}")
    near, after = text[a - 1 : a], text[b : b + 1]
    out.append(f"edge={near.isalnum()}{near in ('.', '-', '_', '/', '=') and bool(near)}:{after.isalnum()}{after in ('-', '_', '/', '=') and bool(after)}")
    return out


class Field:
    """Weights for (feature, kind); the score of a token outside entities is 0."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))

    def lattice(self, text: str, toks: list, grow: bool, seeds: list[tuple[int, int]] | None = None) -> list[tuple[int, int, np.ndarray]]:
        """Candidate segments (first, last, features): they touch a seed and begin and end sensibly."""
        seeds = seeds_of(text, 0, len(text)) if seeds is None else seeds
        useful, k = [], 0
        for _, a, b in toks:
            while k < len(seeds) and seeds[k][1] <= a:
                k += 1
            useful.append(k < len(seeds) and seeds[k][0] < b)
        out = []
        for i in range(len(toks)):
            if not (toks[i][0].isalnum() or toks[i][0] in "+("):
                continue
            for j in range(i, min(len(toks), i + LONGEST)):
                if toks[j][0].isalnum() and any(useful[i : j + 1]) and "\n" not in text[toks[i][1] : toks[j][2]]:
                    f = [self.ids.setdefault(x, len(self.ids)) if grow else self.ids.get(x, -1) for x in _features(text, toks, i, j)]
                    out.append((i, j, np.array([x for x in f if x >= 0], np.int64)))
        return out

    def best(self, text: str, toks: list, seeds: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the most probable segmentation; seeds: those of the whole text where None."""
        n = len(toks)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        ends: dict[int, list] = {}
        for i, j, f in self.lattice(text, toks, False, seeds):
            w = self.w[f].sum(axis=0)
            k = int(w.argmax())
            ends.setdefault(j + 1, []).append((i, float(w[k]), k))
        for t in range(1, n + 1):
            score[t] = score[t - 1]
            for i, w, k in ends.get(t, ()):
                if score[i] + w > score[t]:
                    score[t], back[t] = score[i] + w, (i, k)
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, k = back[t]
                out.append((k, toks[i][1], toks[t - 1][2]))
                t = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.25, shrink: float = 1e-4) -> Field:
        """Gradient steps (AdaGrad) on the conditional log-likelihood."""
        cases = []
        for text, spans in examples:
            toks = tokens(text, 0, len(text))
            cases.append((len(toks), self.lattice(text, toks, grow=True), {(i, j): k for k, a, b in spans for i, t in enumerate(toks) for j, u in enumerate(toks) if t[1] == a and u[2] == b}))
        self.w = np.zeros((len(self.ids), len(KINDS)))
        seen = np.full_like(self.w, 1e-6)
        for _ in range(rounds):
            for n, segments, gold in cases:
                w = [self.w[f].sum(axis=0) for _, _, f in segments]
                forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                forward[0] = backward[n] = 0.0
                ends: dict[int, list[int]] = {}
                starts: dict[int, list[int]] = {}
                for s, (i, j, _) in enumerate(segments):
                    ends.setdefault(j + 1, []).append(s)
                    starts.setdefault(i, []).append(s)
                total = [float(np.logaddexp.reduce(x)) for x in w]
                for t in range(1, n + 1):
                    forward[t] = np.logaddexp.reduce([forward[t - 1], *(forward[segments[s][0]] + total[s] for s in ends.get(t, ()))])
                for t in range(n - 1, -1, -1):
                    backward[t] = np.logaddexp.reduce([backward[t + 1], *(backward[segments[s][1] + 1] + total[s] for s in starts.get(t, ()))])
                for s, (i, j, f) in enumerate(segments):
                    p = np.exp(forward[i] + w[s] + backward[j + 1] - forward[n])
                    g = -p
                    if (k := gold.get((i, j))) is not None:
                        g[k] += 1
                    if np.abs(g).max() > 1e-4:
                        seen[f] += g * g
                        self.w[f] += rate * (g - shrink * self.w[f]) / np.sqrt(seen[f])
        return self


def examples(count: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with spans: every kind in several spellings, and numbers that are none of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "er", "on", "re", "ti", "es", "ou", "la", "de", "ch", "ung", "ment", "que", "ción")) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def checked(n: int, good: bool) -> str:
        d = r.choice("3456") + num(n - 2)
        right = next(c for c in "0123456789" if luhn(d + c))
        return d + (right if good else r.choice([c for c in "0123456789" if c != right]))

    def spaced(d: str) -> str:
        sep = r.choice(("", " ", "-", "."))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        at, dot = r.choice((("@", "."), (" @ ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) ")))
        user = word() + r.choice(("", num(2), "." + word(), "_" + word()))
        return f"{user}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+{r.choice('1234')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"00{r.randint(1, 99)} {a} {b}{c}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}"))

    def ip() -> str:
        sep = r.choice((".", ".", " . "))
        return sep.join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        year = r.randint(1990, 2030)
        return r.choice((f"version {num(1)}.{num(1)}.{num(2)}", f"{year}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{num(2)}", f"{year}-{year + 1} {num(4)}", f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", checked(16, False), spaced(checked(16, False)), num(r.randint(1, 24)), f"{num(3)}.{num(3)}.{num(3)},{num(2)}", f"@{word()}", f"{word()} @ {num(2)}", f"order {num(10)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}", f"ref {num(3)}-{num(4)}-{num(5)}-{num(3)}", "".join(r.choice("0123456789abcdef") for _ in range(20)), f"{num(4)}/{num(4)}-{num(6)}", f"Version 2.0 {num(4)}"))

    makers = {0: email, 1: ip, 2: lambda: spaced(checked(r.choice((13, 15, 16, 16, 19)), True)), 3: phone}
    announce = {0: ("email", "mail"), 1: ("ip", "host"), 2: ("card", "visa"), 3: ("phone", "tel", "call")}
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice((0, 1, 2, 3, None, None))
            lead = r.choice((" ", ", ", ". ", f" {word()} ", f" {r.choice(announce[kind])}: " if kind is not None else " no. "))
            s = makers[kind]() if kind is not None else other()
            text += lead
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice((" ", ". ", ", ", f" {word()} {word()}"))
        out.append((text, spans))
    return out


def seeds_of(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    return [m.span() for m in SEED.finditer(text, start, stop)]


def _around(text: str, a: int, b: int, start: int, stop: int) -> tuple[int, int]:
    """The seed from a to b with as many tokens on each side as a segment and its features may reach, between start and stop."""
    reach = LONGEST + 2
    for size in itertools.count(6):
        low, high = max(start, a - (1 << size)), min(stop, b + (1 << size))
        while start < low and _one(text[low - 1], text[low]):  # to the edge of a token
            low -= 1
        while high < stop and _one(text[high - 1], text[high]):
            high += 1
        if (low == start or len(tokens(text, low, a)) >= reach) and (high == stop or len(tokens(text, b, high)) >= reach):
            return low, high


def _one(x: str, y: str) -> bool:
    """Whether two neighbouring characters may be of one token."""
    return (x.isdecimal() and y.isdecimal()) or (x.isalnum() and y.isalnum() and not (x.isdecimal() or y.isdecimal()))


def gaps(taken: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What lies between spans, which may overlap and nest."""
    out, at = [], 0
    for a, b in [*sorted(taken), (size, size)]:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and spans that the field adds beside them."""
    text = text or ""
    sure, more = base(text), []
    if not SEED.search(text):
        return sure, more
    for start, stop in gaps([(a, b) for _, a, b in sure], len(text)):
        stretches: list[tuple[int, int, list]] = []
        for seed in seeds_of(text, start, stop):
            a, b = _around(text, *seed, start, stop)
            if stretches and a <= stretches[-1][1]:
                stretches[-1] = (stretches[-1][0], max(b, stretches[-1][1]), [*stretches[-1][2], seed])
            else:
                stretches.append((a, b, [seed]))
        for a, b, seeds in stretches:
            more += field.best(text, tokens(text, a, b), seeds)
    return sure, more


@functools.cache
def trained() -> Field:
    """The field fit on the generated examples, once for a program."""
    return Field().fit(examples())


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, added array<struct<kind:string,start:long,stop:long>>"
_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("base", _span), ("added", _span)])


def entities(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added spans."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())
    struct = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in sorted(spans)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in pieces(whole, "text"):
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sure, more = find(text, held.value)
                    rows.append({"doc_id": doc_id, "base": struct(sure), "added": struct(more)})
                yield from batches(rows, ARROW)

    return texts(docs).mapInArrow(trimmed(run), SCHEMA)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all other columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())
    narrow(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in pieces(whole, "text"):
                out = []
                for text in b.column(at).to_pylist():
                    if text is not None:
                        sure, more = find(text, held.value)
                        end, parts = 0, []
                        for a, e, k in sorted((a, e, k) for k, a, e in (*sure, *more)):
                            if a >= end:
                                parts += [text[end:a], f"<{KINDS[k]}>"]
                            end = max(end, e)
                        text = "".join([*parts, text[end:]])
                    out.append(text)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, b.column(at).type), *b.columns[at + 1 :]], schema=b.schema)

    return docs.mapInArrow(trimmed(run), schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans, ordered by kind as in KINDS, then start."""

    def of(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    base, both = F.col("base"), F.concat("base", "added")
    by_start = F.concat(*(F.array_sort(of(both, k), lambda x, y: (F.signum(x["start"] - y["start"]) * 2 + F.signum(x["stop"] - y["stop"])).cast("int")) for k in KINDS))
    counts = [F.size(of(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(by_start).alias("spans"))
