"""Personal data: base patterns, and a semi-Markov conditional random field that adds to them.

The field segments the tokens around digits and ``@`` signs, as many as an
entity can have.  A segment is one token outside entities, or an entity of at
most ``MOST`` tokens of one type (20 digits, 80 characters if no address); its features describe the whole span (digit count, checksum, grouping,
separators, domain, borders, word before).  Dynamic programming over segment
ends picks boundaries and types jointly; entity lengths are bounded, so it is
linear in the text.  Weights maximise the conditional likelihood of sentences
that are generated from a seed: random words with personal data in many
notations, and with numbers, dates, versions, hashes and prices that are none.

Base matches always stay.  Of the field's segments, those that overlap no base
match are added.

Defined results: null text is empty; texts without personal data give zero
counts and an empty list; a null doc_id stays null; repeated rows each give a
row; spans that begin together go by kind as listed, and of equally good
segmentations the one with fewer entities stands; base matches and regions take
time linear in the text; other columns, whatever their names, are not read; an
empty table gives no rows.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),  # a match begins where digits do
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"  # of addresses, before the @
HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
TRIGGER = re.compile(r"[\d@]")
TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")
MOST = {"email": 16, "ip": 7, "card": 11, "phone": 13}  # tokens
REACH = max(MOST.values())  # tokens: an entity has no more, and a trigger among them
CUES = {"email": ("mail", "email", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile")}
SENTENCES, STEPS = 500, 40
PER_KIND = 14
NO_ID = -(2**63)  # stands for a null doc_id inside tasks
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = plain_digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first, in linear time: from each ``@`` both ways."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        own = len(before) - len(before.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if own else None
        if host:
            yield at - own, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base matches, in order."""
    found = [(s, 0, e) for s, e in addresses(text)]
    for number, kind in enumerate(KINDS[1:], 1):
        if kind != "phone" or "+" in text:
            found += [(m.start(), number, m.end()) for m in BASE[kind].finditer(text) if valid(kind, m.group())]
    return sorted(found)


def tokens_before(text: str, at: int, free: int) -> int:
    """Where the ``REACH`` tokens before ``at`` begin, not before ``free``."""
    width = 8 * REACH
    while True:
        low = max(free, at - width)
        starts = [m.start() for m in TOKEN.finditer(text, low, at)]
        if low == free or len(starts) > REACH:  # the first may be the rest of a token
            return starts[-REACH] if len(starts) > REACH else low
        width *= 4


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of tokens that have a digit or ``@`` within ``REACH`` tokens."""
    m, free = TRIGGER.search(text), 0
    while m:
        low, room, high = tokens_before(text, m.start(), free), REACH, m.start()
        for token in TOKEN.finditer(text, m.start()):
            room = REACH if text[token.start()] == "@" or text[token.start()].isdigit() else room - 1
            if room < 0:
                break
            high = token.end()
        yield low, high
        free = high
        m = TRIGGER.search(text, high)


def describe(kind: str, span: str, before: str, after: str, cue: str) -> list[float] | None:
    """Features of a whole span as an entity of the kind; None if it can't be one."""
    if kind != "email" and len(span) > 80:  # more than any of their 20 digits need
        return None
    digits, spaces = plain_digits(span), span.count(" ")
    edges = [1.0, float(before in " \n\t([{<\"',:;="), float(after[0] in " \n\t)]}>\"',.;!?"), float(cue in CUES[kind])]
    if kind == "email":
        if span.count("@") != 1:
            return None
        user, host = (x.strip() for x in span.split("@"))
        if not user or "." not in host:
            return None
        top = host.rsplit(".", 1)[1]
        own = [float(top.isalpha() and 2 <= len(top) <= 6), float(spaces), float(bool(re.fullmatch(r"[\w.%+-]+", user))), float(bool(re.fullmatch(r"[\w-]+(\.[\w-]+)+", host))), float(before.isalnum() or before in "._%+-"), float(after[0].isalnum()), float(after[0] in ".-" and after[1].isalnum())]
    elif kind == "ip":
        parts = span.split(".")
        if len(parts) != 4 or len(digits) > 20 or not all(p.isdigit() and p.isascii() for p in parts):
            return None
        own = [float(valid("ip", span)), float(all(len(p) <= 3 for p in parts)), float(before in ".-" or before.isalnum()), float(after[0] == "-"), float(len(digits) >= 7), 0.0]
    elif len(digits) < 7 or len(digits) > 20 or any(c.isalpha() or c in "@_" for c in span):
        return None
    elif kind == "card":
        groups = re.split(r"[ .-]", span)
        own = [float(14 <= len(digits) <= 19), float(luhn(digits)), float(all(len(g) == 4 for g in groups)), float(len(groups) == 1), float(before.isalnum() or before in ".-+$"), float(any(c not in " -." for c in span if not c.isdigit()))]
        own += [own[0] * own[1]]
    else:
        groups = [len(g) for g in re.findall(r"\d+", span)]
        own = [float(10 <= len(digits) <= 13), float(span[0] == "+"), float("(" in span and span.count("(") == span.count(")")), float(groups[-2:] in ([3, 4], [4, 4])), float(len(groups) == 1), float(before.isalnum() or before in ".-$(+"), float(span.count("(") != span.count(")")), float("." in span), float(len(groups) > 5), float(len(groups) >= 3 and len(digits) == 10)]
    return edges + own + [0.0] * (PER_KIND - len(edges) - len(own))


def candidates(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, np.ndarray]]]]:
    """Tokens of a region, and for each token end the entities (first token, kind, features) that end there."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
    ends: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in tokens]
    for i, (start, stop) in enumerate(tokens):
        first = text[start]
        if not (first.isalnum() or first in "+("):
            continue
        before = text[start - 1] if start else " "
        m = re.search(r"(\w+)\W*$", text[max(0, start - 24) : start])
        cue = m[1].lower() if m else ""
        digits, at = 0, False
        for j in range(i, min(i + max(MOST.values()), len(tokens))):
            s, e = tokens[j]
            if j > i and (s - tokens[j - 1][1] > 1 or s > tokens[j - 1][1] and text[tokens[j - 1][1]] != " "):
                break
            digits += (e - s) * text[s].isdigit()
            at |= text[s] == "@"
            if not text[s].isalnum() or not at and digits < 4:
                continue
            span, after = text[start:e], text[e : e + 2] + "  "
            for number, kind in enumerate(KINDS):
                if j - i < MOST[kind] and (kind == "email") == at:
                    f = describe(kind, span, before, after, cue)
                    if f:
                        ends[j].append((i, number, np.array(f)))
    return tokens, ends


def scored(ends: list, weights: np.ndarray) -> list[list[tuple[int, int, float]]]:
    return [[(i, k, float(weights[k] @ f)) for i, k, f in at] for at in ends]


def decode(ends: list[list[tuple[int, int, float]]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first token, last token, kind)."""
    best, back = [0.0], [None]
    for j, at in enumerate(ends):
        top, how = best[j], None
        for i, k, s in at:
            if best[i] + s > top:
                top, how = best[i] + s, (i, j, k)
        best.append(top)
        back.append(how)
    out, j = [], len(ends)
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def expectations(ends: list[list[tuple[int, int, float]]]) -> list[list[float]]:
    """Each candidate's probability of being a segment, by forward and backward sums."""
    n = len(ends)
    forward = np.zeros(n + 1)
    for j, at in enumerate(ends):
        forward[j + 1] = np.logaddexp.reduce([forward[j], *[forward[i] + s for i, _, s in at]])
    backward = np.full(n + 1, -np.inf)
    backward[n] = 0.0
    for j in range(n - 1, -1, -1):
        for i, _, s in ends[j]:
            backward[i] = np.logaddexp(backward[i], backward[j + 1] + s)
        backward[j] = np.logaddexp(backward[j], backward[j + 1])
    return [[float(np.exp(forward[i] + s + backward[j + 1] - forward[n])) for i, _, s in at] for j, at in enumerate(ends)]


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its entities (start, end, kind)."""
    word = lambda: "".join(rng.choice("aeiounrstlhd") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok: bool) -> str:
        n = rng.choice([15, 16, 16, 16])
        body = rng.choice("3456") + digits(n - 2)
        good = next(c for c in "0123456789" if luhn(body + c))
        s = body + (good if ok else str((int(good) + rng.randint(1, 9)) % 10))
        sep = rng.choice(["", "", "-", " ", "."])
        return sep.join(s[i : i + 4] for i in range(0, n, 4))

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + digits(2), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"+1{a}{b}{c}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        return f"{word()}{rng.choice(['', '.', '_'])}{digits(rng.randint(0, 2))}{rng.choice(['@', '@', '@', ' @ '])}{word()}{rng.choice(['', str(rng.randint(0, 9))])}.{rng.choice(['com', 'org', 'example.com', 'co.uk', 'de'])}"

    entity = [email, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: card(True), phone]
    other = [
        lambda: card(False), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: "$" + digits(3) + "." + digits(2),
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: digits(rng.randint(1, 9)), lambda: "@" + word(), lambda: hashlib.md5(word().encode()).hexdigest()[: rng.randint(8, 32)],
        lambda: f"{digits(3)} {digits(3)} {digits(2)}", lambda: f"{digits(4)}:{digits(2)}", lambda: "AKIA" + hashlib.md5(word().encode()).hexdigest()[:16].upper(), lambda: digits(2) + "/" + digits(2) + "/" + digits(4),
        lambda: digits(rng.choice([10, 11, 12, 13])), lambda: f"{digits(2)}-{digits(5)}-{digits(3)}", lambda: " ".join(digits(4) for _ in range(rng.randint(2, 5))),
    ]
    text, spans = word(), []
    for _ in range(rng.randint(1, 3)):
        text += " " + " ".join(word() for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.55:
            k = rng.randrange(4)
            if rng.random() < 0.2:
                text += " " + rng.choice(CUES[KINDS[k]]) + rng.choice(["", ":"])
            text = text.rstrip() + " "
            value = entity[k]()
            spans.append((len(text), len(text) + len(value), k))
            text += value + rng.choice(["", "", ".", ","])
        else:
            text = text.rstrip() + " " + rng.choice(other)()
    return text + " " + word() + ".", spans


@functools.cache
def train(sentences: int = SENTENCES, steps: int = STEPS, seed: int = 11) -> np.ndarray:
    """Weights (kind, feature) by gradient ascent on the conditional likelihood."""
    rng, data = random.Random(seed), []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens, ends = candidates(text, 0, len(text))
        gold = {(a, b, k) for a, b, k in spans}
        truth = [[float((tokens[i][0], tokens[j][1], k) in gold) for i, k, _ in at] for j, at in enumerate(ends)]
        data.append((ends, truth))
    w = np.zeros((len(KINDS), PER_KIND))
    w[:, 0] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -1e-3 * w * sentences
        for ends, truth in data:
            for at, true, p in zip(ends, truth, expectations(scored(ends, w))):
                for (_, k, f), y, q in zip(at, true, p):
                    g[k] += (y - q) * f
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        w = w + 0.5 * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-6)
    return w


def field_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the entities that the field finds."""
    out = []
    for low, high in regions(text):
        tokens, ends = candidates(text, low, high)
        if any(ends):
            out += [(tokens[i][0], k, tokens[j][1]) for i, j, k in decode(scored(ends, weights))]
    return out


def find_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken: list[list[int]] = []  # the base matches' union, as separate stretches
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    added, i = [], 0
    for s, k, e in sorted(set(field_spans(text, weights))):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i == len(taken) or e <= taken[i][0]) and (not added or added[-1][2] <= s):
            added.append((s, k, e))
    return base, sorted(base + added)


def show(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and the hash of base matches, and all spans, of every row."""
    weights = train()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                base, spans = find_spans(text or "", weights)
                count = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((doc, *count, hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInPandas(scan, RESULT).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
