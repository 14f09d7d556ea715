"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field works on chains: runs of digit groups, and addresses spelt out. Its lattice has an arc for
each candidate segment and kind, scored by features of the whole span, and unit arcs for what
belongs to no entity. Forward sums train it; a best path over segments of bounded
length chooses boundaries and kinds together.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmesa.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

# Each follows the pattern of its kind; lookbehinds and possessive repeats keep them linear and change no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Goes from one at sign to the next, as a scan from the left would: each takes the longest local part behind the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _HOST.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return found


# --- the field

#: Digit groups in a segment, and characters of context on either side.
MAX_GROUPS, CONTEXT = 8, 24
_CHAIN = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().\-/:]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_SPELT = re.compile(r"(?<![\w.+%-])[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\s?)[A-Za-z0-9-]{1,63})+", re.I)
_SPELT_SIGN = re.compile(r"[\[({]at[\])}]|\x20at\x20", re.I)
_CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "whatsapp", "ring", "contact"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "pan"),
    "ip": ("ip", "host", "server", "address", "addr", "gateway", "dns", "router", "login", "client"),
    "email": ("email", "mail", "e-mail", "contact", "write", "correo", "courriel"),
}


def candidates(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Chains of a text as (start, end, segments); segments are ascending by end. Only chains that could hold an entity."""
    if _SPELT_SIGN.search(text):
        for m in _SPELT.finditer(text):
            yield m.start(), m.end(), [m.span()]
    if not _DIGIT.search(text):
        return
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        out = []
        for j in range(len(groups)):
            digits = 0
            for i in range(j, max(-1, j - MAX_GROUPS), -1):
                digits += groups[i][1] - groups[i][0]
                if digits > 19:
                    break
                if digits >= 7 or j - i == 3:
                    a = groups[i][0]
                    low = groups[i - 1][1] if i else m.start()
                    while a > low and text[a - 1] in "+(":
                        a -= 1
                    out.append((a, groups[j][1]))
        if out:
            yield m.start(), m.end(), out


@lru_cache(1 << 16)
def features(span: str, left: str, right: str, first: bool, last: bool, spelt: bool) -> dict[str, tuple[str, ...]]:
    """For each kind that a segment may be, the names of what holds for it as an entity of that kind.

    left, right: what stands beside it; first, last: whether it begins or ends its chain. What repeats is described once.
    """
    groups = [len(g) for g in _GROUP.findall(span)]
    seps = re.sub(r"[0-9]+", "", span.lstrip("+("))
    words = [w.strip(".,:;()[]\"'=#").lower() for w in left.split()][-2:]
    shared = ["any", f"digits{sum(groups)}", f"groups{min(len(groups), 6)}", "shape" + "-".join(str(min(g, 6)) for g in groups[:6]), "seps" + "".join(sorted(set(seps)))]
    shared += [f"start{span[0] if span[0] in '+(' else '0' if span[0] == '0' else 'd'}", f"edges{first}{last}"]
    shared.append(f"touch{left[-1:].isalnum() or left[-1:] in ('.', '-', '/', '_', '#', '$', '€')}{right[:1].isalnum() or right[:1] in ('%', '/', '_', '-') or (right[:1] == '.' and right[1:].isdigit())}")
    own = {
        "email": lambda: [f"signs{bool(re.search(r'[\[({]at', span, re.I))}{bool(re.search(r'dot', span, re.I))}{'.' in span}"],
        "ip": lambda: [f"octets{len(groups) == 4 and all(p.isdigit() and octet(p) for p in span.split('.'))}"],
        "card": lambda: [f"luhn{luhn(_only_digits(span))}"],
        "phone": lambda: [f"one{len(set(seps) - set('()'))}", f"date{bool(re.match(r'(19|20)[0-9]{2}[-./][01]?[0-9][-./]|[0-3]?[0-9][-./][01]?[0-9][-./](19|20)[0-9]{2}', span))}"],
    }
    return {kind: tuple([f"{kind}:{f}" for f in (*shared, f"cue{any(w in _CUES[kind] for w in words)}", *own[kind]())]) for kind in (("email",) if spelt else KINDS[1:])}


def arcs(text: str, chain: tuple[int, int, list[tuple[int, int]]]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    a, b, segments = chain
    spelt = _SPELT_SIGN.search(text, a, b) is not None
    return [(x, y, kind, names) for x, y in segments for kind, names in features(text[x:y], text[max(0, x - CONTEXT) : x], text[y : y + 2], x == a, y == b, spelt).items()]


def _positions(found: list[tuple[int, int, str, tuple[str, ...]]]) -> dict[int, int]:
    return {p: k for k, p in enumerate(sorted({p for x in found for p in x[:2]}))}


def decode(found: list[tuple[int, int, str, tuple[str, ...]]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best choice of segments that do not overlap; what scores below leaving it out stays out."""
    at = _positions(found)
    best, back = [0.0] * len(at), [None] * len(at)
    ending: dict[int, list] = {}
    for x in found:
        ending.setdefault(at[x[1]], []).append(x)
    for k in range(len(at)):
        if k:
            best[k], back[k] = best[k - 1], None
        for x in ending.get(k, ()):
            score = best[at[x[0]]] + sum([weights.get(f, 0.0) for f in x[3]])
            if score > best[k]:
                best[k], back[k] = score, x
    out, k = [], len(at) - 1
    while k > 0:
        if back[k] is None:
            k -= 1
        else:
            out.append((back[k][2], back[k][0], back[k][1]))
            k = at[back[k][0]]
    return out[::-1]


def train(rows: int = 1500, rounds: int = 8, seed: int = 7) -> dict[str, float]:
    """Weights by stochastic ascent of the conditional likelihood on invented lines with known spans."""
    made = list(invented(rows, seed))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    lattices = []
    for text, gold in made:
        for chain in candidates(text):
            found = arcs(text, chain)
            true = {(k, a, b) for k, a, b in gold}
            lattices.append((found, [(x[2], x[0], x[1]) in true for x in found]))
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(lattices)
        for found, gold in lattices:
            at = _positions(found)
            n = len(at)
            score = [sum([weights.get(f, 0.0) for f in x[3]]) for x in found]
            forward, backward = np.full(n, -np.inf), np.full(n, -np.inf)
            forward[0] = backward[n - 1] = 0.0
            ends, starts = {}, {}
            for x, s in zip(found, score, strict=True):
                ends.setdefault(at[x[1]], []).append((at[x[0]], s))
                starts.setdefault(at[x[0]], []).append((at[x[1]], s))
            for k in range(1, n):
                forward[k] = np.logaddexp.reduce([forward[k - 1], *(forward[i] + s for i, s in ends.get(k, ()))])
            for k in range(n - 2, -1, -1):
                backward[k] = np.logaddexp.reduce([backward[k + 1], *(backward[j] + s for j, s in starts.get(k, ()))])
            for x, s, g in zip(found, score, gold, strict=True):
                p = float(np.exp(forward[at[x[0]]] + s + backward[at[x[1]]] - forward[n - 1]))
                step = g - p
                if abs(step) > 1e-3:
                    for f in x[3]:
                        squares[f] = squares.get(f, 1.0) + step * step
                        weights[f] = weights.get(f, 0.0) * 0.9999 + 0.5 * step / squares[f] ** 0.5
    return weights


def invented(rows: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with spans of each kind in many layouts, and lines with numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "re", "tion", "the", "ou", "ch", "er", "de", "la", "st")) for _ in range(r.randint(1, 3)))

    def card() -> str:
        n = r.choice((13, 15, 16, 16, 16, 16, 19))
        body = r.choice("3456") + d(n - 2)
        check = next(c for c in "0123456789" if luhn(body + c))
        s, sep = body + check, r.choice(("", " ", "-", ".", "  "))
        return sep.join(s[i : i + 4] for i in range(0, n, 4)) if n != 15 else sep.join((s[:4], s[4:10], s[10:]))

    def phone() -> str:
        c = r.choice(("+1", "+49", "+33", "+34", "+44", "001", "0049"))
        return r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}", f"{r.randint(2, 9)}{d(2)} {d(3)} {d(4)}", f"{c} ({d(3)}) {d(3)}-{d(4)}", f"{c}-{d(3)}-{d(3)}-{d(4)}", f"{c} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}"))

    def none() -> str:
        return r.choice((f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)} {r.randint(0, 23):02}:{d(2)}", d(r.randint(7, 12)), d(r.randint(13, 19)), f"{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}.{d(4)}", f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", " ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 12))), f"{d(4)}-{d(4)}", f"{d(2)}:{d(2)}:{d(2)}.{d(3)}", f"{word()}{d(9)}", f"{d(8)}{word()}", f"{d(3)}.{d(6)}"))

    def spelt() -> tuple[str, bool]:
        a, s, dot = r.choice((("[at]", "", "[dot]"), ("(at)", "", "."), (" [at] ", "", " [dot] "), (" (at) ", "", " (dot) "), (" at ", "", " dot "), (" at ", "no", ".")))
        return f"{word()}{r.choice(('.', '_', ''))}{word()}{a}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}", s == ""

    for _ in range(rows):
        parts, spans, at = [], [], 0

        def put(s: str, kind: str = "") -> None:
            nonlocal at  # noqa: B023
            if parts:  # noqa: B023
                parts.append(" ")  # noqa: B023
                at += 1  # noqa: B023
            if kind:
                spans.append((kind, at, at + len(s)))  # noqa: B023
            parts.append(s)  # noqa: B023
            at += len(s)  # noqa: B023

        for _ in range(r.randint(2, 4)):
            for _ in range(r.randint(1, 4)):
                put(word())
            x = r.random()
            if x < 0.55:
                put(none())
            elif x < 0.65:
                s, good = spelt()
                put(s, "email" if good else "")
            else:
                kind = r.choice(("phone", "phone", "card", "ip"))
                if r.random() < 0.4:
                    put(r.choice(_CUES[kind]) + r.choice((":", "", " no.")))
                put({"phone": phone, "card": card, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))}[kind](), kind)
            put(word() + r.choice((".", ",", "")))
        yield "".join(parts), spans


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the spans of the field that touch none of them. Both by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    more = []
    for chain in candidates(text):
        for kind, a, b in decode(arcs(text, chain), weights):
            k = bisect_left(begins, b)  # base spans that begin before the end
            if not k or reach[k - 1] <= a:
                more.append((kind, a, b))
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def find_personal_data(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end in code points).

    Base spans have no bound. A segment of the field has at most MAX_GROUPS digit groups and 19 digits; an address that is spelt out has
    at most 64 characters before the sign and 63 in a label, as addresses may have.

    Null text counts as empty and has no spans; rows with equal or null ids each give a row; an
    empty table gives none; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, listings = [[] for _ in KINDS], [], []
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "", weights)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(1 for s in base if s[0] == k))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                listings.append(listed(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listings, pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select(df[id_col], df[text_col]).mapInArrow(rows, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind in capitals and angle brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask_personal_data(df: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """df with the spans in its texts masked, all other columns as they are; null text stays null."""
    return map_texts(df, lambda texts: [t and masked(t, all_spans(t, weights)[1]) for t in texts], text_col)
