"""Personal data by a semi-Markov conditional random field over candidate segments.

Method. A segment is a whole span with a type; its features (shape, digit counts, checksum, words before it) are of the span
at once. Base patterns and looser shapes propose segments of at most ``MAX_TOKENS`` tokens; each shape needs a digit,
``@`` or a spelt-out ``(at)`` or ``[at]``. So the dynamic program runs over the stretches around those: as far to both
sides as a segment's tokens and the words that its features look at can reach, which gives what decoding the whole text
gives. It chooses boundaries and types jointly: best score over segmentations whose entities have bounded length. Weights are
trained here, by gradient ascent on the conditional likelihood (forward-backward over the same segments) of sentences
that a seeded generator labels; their number is the documented bound ``TRAIN``.

Valid base spans are spans in any case (the contract); decoded entities that touch none of them are added, with kinds
of their own (``ssn``, ``iban``, ``birth``) or the base kinds for shapes that base patterns miss.

Edge cases: null and empty texts have no spans; every row is handled alone, so repeated rows, ties and hot keys don't
matter; very long texts cost time in proportion; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "birth")
MAX_TOKENS, CUE_WORDS, TRAIN, EPOCHS, SEED = 16, 3, 400, 6, 7

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-zÀ-ÿ]+|[0-9]+|\S")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]+|\(at\)|\[at\]|\[dot\]")
AT = ("(at)", "[at]")
#: What a segment of a type can look like at all.
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?(@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+((\.|\x20?\[dot\]\x20?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9]){13,18}"),
    "phone": re.compile(r"(\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?([\x20.-]?[0-9]{2,4}){2,4}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){3,7}(\x20?[A-Z0-9]{1,4})?"),
    "birth": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
}
CUES = {w: k for k, ws in {"phone": ("call", "phone", "tel", "mobile", "fax"), "card": ("card", "visa", "credit"), "ssn": ("ssn", "social"), "iban": ("iban", "account"), "birth": ("born", "birth", "dob"), "ip": ("ip", "host", "address"), "email": ("mail", "email", "contact"), "none": ("version", "order", "isbn", "page", "total", "nr", "no", "invoice", "ref")}.items() for w in ws}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Valid base spans (start, end, kind), leftmost and not overlapping within a kind."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = EMAIL_TAIL.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text) if text.count(".") >= 3 else ():
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(only_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


# the model -------------------------------------------------------------------------------------------------------------
def _before(text: str, at: int) -> int:
    """A word boundary so far back that ``MAX_TOKENS`` tokens, and ``CUE_WORDS`` words before those, lie between it and ``at``."""
    size = 128
    while True:
        lo = max(0, at - size)
        while lo and not text[lo - 1].isspace():
            lo -= 1
        if lo == 0 or sum(t.isalpha() for t in TOKEN.findall(text, lo, at)[:-MAX_TOKENS]) >= CUE_WORDS:
            return lo
        size *= 2


def _after(text: str, at: int) -> int:
    size = 64
    while True:
        hi = min(len(text), at + size)
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if hi == len(text) or len(TOKEN.findall(text, at, hi)) > MAX_TOKENS:
            return hi
        size *= 2


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers that hold all segments near them, and the words before those, whole."""
    near: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if near and m.start() - near[-1][1] < 64:
            near[-1][1] = m.end()
        else:
            near.append([m.start(), m.end()])
    out: list[list[int]] = []
    for s, e in near:
        lo, hi = _before(text, s), _after(text, e)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def features(kind: str, span: str, before: tuple[str, ...]) -> list[str]:
    d = only_digits(span)
    cues = [CUES.get(w) for w in before]
    out = [kind, f"{kind}:n{min(len(d), 20)}", f"{kind}:cue" if kind in cues else f"{kind}:nocue"]
    if "none" in cues or any(c not in (None, kind, "none") for c in cues):
        out.append(f"{kind}:other")
    if kind == "email":
        labels = re.split(r"\.|\x20?\[dot\]\x20?", re.split(r"@|\(at\)|\[at\]", span)[1])
        out += [f"email:labels{min(len(labels), 4)}", f"email:top{labels[-1].isalpha() and 2 <= len(labels[-1]) <= 4}"]
    elif kind == "card":
        out.append(f"card:luhn{luhn(d)}")
    elif kind == "ip":
        out.append(f"ip:{all(int(p) <= 255 for p in span.split('.'))}")
    elif kind == "phone":
        out += [f"phone:plus{span[0] == '+'}", f"phone:sep{sum(not c.isdigit() for c in span) > 1}"]
    elif kind == "birth":
        parts = [int(p) for p in re.split(r"[-/.]", span)]
        out.append(f"birth:{any(1900 <= p <= 2025 for p in parts) and sorted(parts)[0] <= 12 and sorted(parts)[1] <= 31}")
    elif kind == "ssn":
        out.append(f"ssn:{d[:3] not in ('000', '666') and d[0] != '9' and d[3:5] != '00' and d[5:] != '0000'}")
    elif kind == "iban":
        value = span.replace(" ", "")
        out.append(f"iban:{int(''.join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1}")
    return out


def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Tokens (start, end), and segments (first token, token after the last, kind, features)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    out = []
    words: list[str] = []
    for i, (start, end) in enumerate(tokens):
        head = text[start]
        joined = i and tokens[i - 1][1] == start and text[start - 1].isalnum() and head.isalnum()
        if (head.isalnum() or head in "+(._%-") and not joined:
            marked = False
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                a, b = tokens[j - 1]
                if j > i + 1 and a - tokens[j - 2][1] > 1:
                    break
                marked |= text[a].isdigit() or text[a] == "@" or (text[a] in ")]" and text[max(0, a - 3) : b] in AT)
                if not marked or (j < len(tokens) and tokens[j][0] == b and text[b].isalnum() and text[b - 1].isalnum()):
                    continue
                span = text[start:b]
                for kind, shape in SHAPES.items():
                    if shape.fullmatch(span):
                        out.append((i, j, kind, features(kind, span, tuple(words[-CUE_WORDS:]))))
        if text[start:end].isalpha():
            words.append(text[start:end].lower())
    return tokens, out


def forward(n: int, segments, score) -> list[float]:
    """log sums of the prefixes' segmentations; a token outside scores 0."""
    ends = defaultdict(list)
    for s in segments:
        ends[s[1]].append(s)
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        values = [alpha[j - 1], *(alpha[s[0]] + score(s) for s in ends[j])]
        top = max(values)
        alpha[j] = top + math.log(sum(math.exp(v - top) for v in values))
    return alpha


def decode(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    tokens, segments = lattice(text)
    if not segments:
        return []
    ends = defaultdict(list)
    for s in segments:
        ends[s[1]].append((s[0], s[2], sum(weights.get(f, 0.0) for f in s[3])))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, kind, value in ends[j]:
            if best[i] + value > best[j]:
                best[j], back[j] = best[i] + value, (i, kind)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their entities from a seeded generator."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "be", "der", "es", "la", "on", "re", "th", "ver", "zu"]) for _ in range(r.randint(1, 4)))

    def card():
        d = r.choice("456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    def bad():  # a card's digits with a wrong checksum
        d = card()
        return d[:-1] + r.choice([c for c in "0123456789" if c != d[-1]])

    def iban():
        code, body = r.choice(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + code + "00")) % 97
        return f"{code}{check:02d}{body}"

    def email():
        local = word() + r.choice([".", "_", ""]) + r.choice([num(2), word(), ""])
        dot = r.choice([".", ".", "[dot]", " [dot] "])
        labels = [word() for _ in range(r.choice([1, 1, 2]))] + [r.choice(["com", "org", "net", "de"])]
        return local.rstrip("._") + r.choice(["@", "@", "[at]", " [at] ", "(at)", " (at) "]) + dot.join(labels)

    make = {
        "email": email,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "bad": bad,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}"]),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "iban": iban,
        "birth": lambda: r.choice(["{0}-{1:02d}-{2:02d}", "{2}.{1}.{0}", "{1}/{2}/{0}"]).format(r.randint(1920, 2015), r.randint(1, 12), r.randint(1, 28)),
        "none": lambda: r.choice([num(r.randint(1, 8)), f"{num(1)}.{num(1)}", f"{num(3)}.{num(3)}", num(16), f"{r.randint(300, 999)}.{num(3)}.{num(1)}.{num(1)}", f"{num(2)}-{num(2)}-{num(3)}", f"{num(1)}.{num(2)}.{num(2)}", f"{num(4)}-{num(4)}-{num(4)}"]),
    }
    cues = defaultdict(list)
    for w, k in CUES.items():
        cues[k].append(w)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice([*KINDS, "none", "none", "bad"])
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if kind in ("birth",) or r.random() < 0.6:
                text += r.choice(cues["card" if kind == "bad" else kind]) + r.choice([" ", ": "])
            value = make[kind]()
            if kind in KINDS:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + r.choice([" ", ", ", ". "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> tuple[tuple[str, float], ...]:
    """Weights that maximise the conditional likelihood of the labelled segmentations (stochastic gradient, L2)."""
    w: dict[str, float] = defaultdict(float)
    data = []
    for text, spans in labelled(n, seed):
        tokens, segments = lattice(text)
        gold = {(a, b, k) for a, b, k in spans}
        data.append((len(tokens), segments, [s for s in segments if (tokens[s[0]][0], tokens[s[1] - 1][1], s[2]) in gold]))
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for count, segments, gold in data:
            score = lambda s: sum(w[f] for f in s[3])
            alpha = forward(count, segments, score)
            mirrored = [(count - s[1], count - s[0], *s[2:]) for s in segments]
            beta = forward(count, mirrored, score)
            for s in segments:
                p = math.exp(alpha[s[0]] + score(s) + beta[count - s[1]] - alpha[count])
                step = rate * ((s in gold) - p)
                if abs(step) > 1e-4:
                    for f in s[3]:
                        w[f] += step - rate * 1e-3 * w[f]
    return tuple(sorted((k, round(v, 6)) for k, v in w.items()))


def spans_of(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans)."""
    if not text:
        return [], []
    base, added = base_spans(text), []
    taken: list[tuple[int, int]] = []
    for s, e, _ in sorted(base):  # base spans of different kinds can overlap
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    starts = [s for s, _ in taken]
    for a, b in stretches(text):
        for s, e, kind in decode(text[a:b], weights):
            s, e = s + a, e + a
            before = bisect_right(starts, e - 1)
            if not before or taken[before - 1][1] <= s:
                added.append((s, e, kind))
    return base, added


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: (doc_id, spans) with start, end, kind and ``base``."""
    fitted = trained()

    def rows(batches):
        weights = dict(fitted)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for t in batch.column(1):
                base, added = spans_of(t.as_py(), weights)
                out.append([{"start": s, "kind": k, "end": e, "base": b} for s, k, e, b in sorted((s, KINDS.index(k), e, b) for some, b in ((base, True), (added, False)) for s, e, k in some)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(rows, "doc_id long, spans array<struct<start: int, kind: int, end: int, base: boolean>>")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return scanned(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
