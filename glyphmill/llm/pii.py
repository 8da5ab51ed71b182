"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole spans of pieces of text (up to LONGEST) as email, ip, card or phone; a dynamic program over
the pieces chooses boundaries and types together. Pieces without a digit, "@" or "(at)" are always outside, so only the
stretches around others are decoded, which loses nothing. It is trained here, on seeded examples of the four kinds
in notations that the patterns miss as well (phones without "+", "(at)" addresses, spaced out ips) and of numbers
that are none (dates, versions, prices, digests, long numbers that aren't valid as cards).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6

# The patterns of the base, written so that no text takes quadratic time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base, by start and kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted((a, b, k) for a, b, k in out) if len(out) < 2 else sorted(out, key=lambda x: (x[0], x[2]))


# --- the field ---------------------------------------------------------------------------------------------------------

PIECE = re.compile(r"\+?\(?[A-Za-z0-9](?:[A-Za-z0-9._%+@-]*[A-Za-z0-9])?\)?")
CORE = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
AT_SIGN = re.compile(r"@| ?[(\[](?:at|AT)[)\]] ?")
JOINS = frozenset(("", " ", "-", ".", " - ", "/", " . "))
#: Words before a span that speak for a kind.
CUES = {
    0: frozenset("mail email e-mail mailto contact correo courriel".split()),
    1: frozenset("ip host server address addr from ping".split()),
    2: frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    3: frozenset("phone tel telephone call mobile fax cell telefon telefono tél".split()),
}
FEATURES = 42
NONE = len(KINDS)
LABELS = NONE + 1


def pieces(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches of pieces that each have a digit or "@" and stand next to each other."""
    stretch: list[tuple[int, int]] = []
    for core in _cores(text):
        if stretch and text[stretch[-1][1] : core[0]] not in JOINS:
            yield stretch
            stretch = []
        stretch.append(core)
    if stretch:
        yield stretch


def _cores(text: str) -> Iterator[tuple[int, int]]:
    at, ahead = 0, 0  # no piece begins between the last place looked at and ahead
    while m := CORE.search(text, at):
        begin = m.start()
        if len(m[0]) > 1:  # name (at) domain
            end = begin - (begin > at and text[begin - 1] == " ")
            begin = end
            while begin > at and text[begin - 1] in LOCAL:
                begin -= 1
            d = DOMAIN.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))
            if begin < end and d:
                yield begin, d.end()
            at = d.end() if d else m.end()
            continue
        while begin > at and (text[begin - 1] in LOCAL or text[begin - 1] in "(@"):
            begin -= 1
        found = False
        for p in PIECE.finditer(text, begin) if ahead <= m.start() else ():
            if p.start() > m.start():
                ahead = p.start()
                break
            if p.end() > m.start():
                yield p.start(), p.end()
                at, found = p.end(), True
                break
        else:
            ahead = max(ahead, len(text) if ahead <= m.start() else 0)
        if not found:
            at = m.start() + 1


def features(span: str, before: str) -> tuple[int, ...]:
    """Features of a whole span and the word before it. Short ones are remembered."""
    return _remembered(span, before) if len(span) + len(before) <= 100 else _features(span, before)


def _features(span: str, before: str) -> tuple[int, ...]:
    d = _digits(span)
    n, letters = len(d), sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    out = [0]
    out.append(1 if not n else 2 if n < 4 else 3 if n < 7 else 4 if n < 9 else 5 if n < 12 else 6 if n == 12 else 7 if n < 16 else 8 if n == 16 else 9 if n < 20 else 10)
    out.append(11 if not letters else 12 if letters > n else 13)
    if "@" in span:
        out.append(14 if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", span) and span.count("@") == 1 else 15)
        if "." in span[span.find("@") + 2 :]:
            out.append(16)
    if span[0] == "+":
        out.append(17)
    if "(" in span:
        out.append(18)
    if "-" in span:
        out.append(19)
    if " " in span:
        out.append(20)
    if "/" in span:
        out.append(21)
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span):
        out.append(22 if all(int(g) <= 255 for g in groups) else 23)
    elif "." in span and not letters:
        out.append(24 if len(groups) < 4 else 25)
    if n >= 12 and not letters:
        out.append(26 if luhn(d) else 27)
    shape = [len(g) for g in groups]
    if len(shape) > 1 and set(shape[:-1]) == {4}:
        out.append(28)
    if shape[-3:] == [3, 3, 4] or shape[-2:] == [3, 4]:
        out.append(29)
    if len(shape) == 3 and sorted(shape) == [2, 2, 4]:
        out.append(30)
    if len(shape) == 1:
        out.append(31)
    elif len(shape) > 4:
        out.append(32)
    word = before.lower()
    out += [33 + k for k, cues in CUES.items() if word in cues]
    if before.endswith(("$", "€", "£", "v", "V", "=")):
        out.append(37)
    if len(shape) > 2 and min(shape) == 1:
        out.append(38)
    if any(s > 19 for s in shape):
        out.append(39)
    if "@" not in span and AT_SIGN.search(span):
        out.append(40)
    if re.fullmatch(r"[0-9]{1,3}(?: \. [0-9]{1,3}){3}", span):
        out.append(41)
    return tuple(out)


_remembered = functools.lru_cache(maxsize=20_000)(_features)


#: Characters of a word that its features look at: one more than the longest cue has, so a cut word is no cue.
CUE = 1 + max(len(x) for cues in CUES.values() for x in cues)


def _before(text: str, at: int) -> str:
    """The end of the word before a place, over any number of blanks and opening signs."""
    end = at
    while end and text[end - 1] in " :\"'(":
        end -= 1
    words = text[max(0, end - CUE) : end].split()
    return words[-1] if words and not text[end - 1].isspace() else ""


def lattice(text: str, stretch: list[tuple[int, int]]) -> Iterator[list[tuple[int, tuple[int, ...]]]]:
    """For each end (in pieces, from 0) the spans that end there: their first piece and features.

    The word before a span is the one next to it if it has a letter, else that before the whole stretch.
    """
    yield []
    lead = _before(text, stretch[0][0])
    near = [lead]
    for j in range(1, len(stretch) + 1):
        if j < len(stretch):
            word = _before(text, stretch[j][0])
            near.append(word if any(c.isalpha() for c in word) else lead)
        b = stretch[j - 1][1]
        yield [(i, features(text[stretch[i][0] : b], near[i])) for i in range(j - 1, max(-1, j - 1 - LONGEST), -1)]


class Field:
    def __init__(self) -> None:
        self.w = np.zeros((LABELS, FEATURES))
        self.move = np.zeros((LABELS, LABELS))

    def scores(self, rows: list) -> list[list[tuple[int, list[float]]]]:
        return [[(i, self.w[:, list(f)].sum(1).tolist()) for i, f in row] for row in rows]

    def best(self, rows: Iterable) -> list[tuple[int, int, int]]:
        """The best labelled segments (first piece, end, label); outside segments are single pieces.

        Time is linear in pieces times LONGEST. Only the last scores are held, and two bytes for each piece and label.
        """
        move = self.move.tolist()
        value, n = {0: [0.0] * LABELS}, 0
        lengths, labels = bytearray(LABELS), bytearray(LABELS)
        for j, row in enumerate(rows):
            if not j:
                continue
            top = [(-math.inf, j, 0)] * LABELS
            for i, own in self.scores([row])[0]:
                for y in range(LABELS):
                    if y == NONE and j - i > 1:
                        continue
                    for z in range(LABELS) if i else (NONE,):
                        v = value[i][z] + move[z][y] + own[y]
                        if v > top[y][0]:
                            top[y] = (v, i, z)
            value[j], n = [t[0] for t in top], j
            value.pop(j - LONGEST, None)
            lengths.extend(j - t[1] for t in top)
            labels.extend(t[2] for t in top)
        out, j = [], n
        y = max(range(LABELS), key=lambda k: value[j][k])
        while j:
            i, z = j - lengths[j * LABELS + y], labels[j * LABELS + y]
            out.append((i, j, y))
            j, y = i, z
        return out[::-1]

    def gradient(self, rows: list, gold: list[tuple[int, int, int]], dw: np.ndarray, dm: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood: counts of the gold segments less those expected."""
        s, n = self.scores(rows), len(rows) - 1
        move = self.move
        ahead = np.full((n + 1, LABELS), -np.inf)
        ahead[0, NONE] = 0.0
        for j in range(1, n + 1):
            for i, own in s[j]:
                v = np.logaddexp.reduce(ahead[i][:, None] + move, axis=0) + own
                if j - i > 1:
                    v[NONE] = -np.inf
                ahead[j] = np.logaddexp(ahead[j], v)
        behind = np.full((n + 1, LABELS), -np.inf)
        behind[n] = 0.0
        total = np.logaddexp.reduce(ahead[n])
        for j in range(n, 0, -1):
            for i, own in s[j]:
                v = np.asarray(own) + behind[j]
                if j - i > 1:
                    v = np.where(np.arange(LABELS) == NONE, -np.inf, v)
                both = ahead[i][:, None] + move + v[None, :] - total
                p = np.exp(both)
                dm -= p
                q = p.sum(0)
                for f in self._features(rows, i, j):
                    dw[:, f] -= q
                behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(move + v[None, :], axis=1))
        last = NONE
        for i, j, y in gold:
            dm[last, y] += 1
            for f in self._features(rows, i, j):
                dw[y, f] += 1
            last = y

    @staticmethod
    def _features(rows: list, i: int, j: int) -> tuple[int, ...]:
        return next(f for k, f in rows[j] if k == i)


def examples(n: int = 600, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Seeded texts with the spans that are personal data."""
    rng = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def email() -> str:
        name = rng.choice(["ann", "j.doe", "info", "x_1", "sales+eu", "was", "m"]) + rng.choice(["", digits(2), "." + digits(2)])
        return name + rng.choice(["@", "@", "@", " (at) ", "(at)", " [at] "]) + rng.choice(["mail.example.com", "mail7.example.org", "example.net", "a-b.co"])

    def ip() -> str:
        return rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card(valid: bool = True) -> str:
        """A number with the check digit of a card, or with another one."""
        d = digits(rng.choice([15, 15, 15, 14, 12, 18]))
        last = [c for c in "0123456789" if luhn(d + c) == valid]
        d += rng.choice(last)
        sep = rng.choice(["", "", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+49{a}{b}{c}", f"00{digits(2)} {a} {b} {c}", f"({a}) {b} {c}", f"{a} {b} {c}"])

    def none() -> str:
        y = str(rng.randint(1900, 2030))
        return rng.choice([
            y, f"{y}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/12/{y}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", digits(rng.randint(1, 8)), digits(10), f"{digits(3)}.{digits(2)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"a{digits(2)}b{digits(3)}c", f"{digits(3)} {digits(2)}", digits(24), "@" + rng.choice(["home", "x1"]), f"v{digits(1)}.{digits(2)}",
            card(False), card(False), card(False), f"{rng.randint(256, 999)}.{digits(3)}.1.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", "ann@localhost",
        ])

    make = (email, ip, card, phone)
    cues = ("mail", "ip", "card", "phone")
    for _ in range(n):
        text, spans = rng.choice(["the ", "Von ", "est "]), []
        for _ in range(rng.choice([1, 1, 2, 3])):
            kind = rng.randrange(7)
            if kind < NONE:
                if rng.random() < 0.15:
                    text += cues[kind] + " "
                s = make[kind]()
                spans.append((len(text), len(text) + len(s), kind))
            else:
                s = none()
            text += s + rng.choice([" ", " ", " and ", ", "])
        yield text, spans


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 14) -> Field:
    """The field, by AdaGrad on the log-likelihood. Examples whose spans the pieces can't express are left out of training."""
    field = Field()
    data = []
    for text, spans in examples():
        for stretch in pieces(text):
            starts, ends = {a: i for i, (a, _) in enumerate(stretch)}, {b: j + 1 for j, (_, b) in enumerate(stretch)}
            mine = [(starts[a], ends[b], k) for a, b, k in spans if a in starts and b in ends and ends[b] - starts[a] <= LONGEST]
            if len(mine) != sum(stretch[0][0] <= a < stretch[-1][1] for a, _, _ in spans):
                continue
            gold, at = [], 0
            for i, j, k in mine:
                gold += [(x, x + 1, NONE) for x in range(at, i)] + [(i, j, k)]
                at = j
            gold += [(x, x + 1, NONE) for x in range(at, len(stretch))]
            data.append((list(lattice(text, stretch)), gold))
    gw, gm = np.full(field.w.shape, 1e-6), np.full(field.move.shape, 1e-6)
    for _ in range(rounds):
        for a in range(0, len(data), 32):
            dw, dm = -0.01 * field.w, -0.01 * field.move
            for rows, gold in data[a : a + 32]:
                field.gradient(rows, gold, dw, dm)
            gw += dw**2
            gm += dm**2
            field.w += 0.5 * dw / np.sqrt(gw)
            field.move += 0.5 * dm / np.sqrt(gm)
    return field


def added(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans of the field that overlap none of the base, which is in order of starts."""
    out: list[tuple[int, int, int]] = []
    begins = [x for x, _, _ in base]
    ends = list(itertools.accumulate((y for _, y, _ in base), max))
    for stretch in pieces(text):
        for i, j, k in field.best(lattice(text, stretch)):
            if k != NONE:
                a, b = stretch[i][0], stretch[j - 1][1]
                before = bisect.bisect_left(begins, b)
                if not before or ends[before - 1] <= a:
                    out.append((a, b, k))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; a row for each row.

    A null or empty text has no spans. Offsets are code points of the whole text. Spans of the base may overlap each other,
    those of the field overlap none; of equally good labelings the first in order of spans is taken. No shuffle.
    """
    field = trained()
    shared = docs.sparkSession.sparkContext.broadcast((field.w, field.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.w, own.move = shared.value
        for batch in batches:
            counts, shas, all_spans = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [0] * len(KINDS)
                for _, _, k in base:
                    kinds[k] += 1
                counts.append(kinds)
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                more = added(text, base, own) if CORE.search(text) else []
                all_spans.append(digest(sorted(base + more, key=lambda x: (x[0], x[2]))))
            n = list(zip(*counts)) if counts else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(shas, pa.string()), pa.array(all_spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"))
