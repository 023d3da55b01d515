"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay.  The field then reads the
stretches of a text that hold digits or an at-sign.  Its states are segments:
a candidate span is scored as a whole (digits and their grouping, check digit,
part values, domain form, what stands on either side, words before it), and
dynamic programming over spans of at most ``MAX_TOKENS`` tokens chooses all
boundaries and types of a stretch jointly.  Spans that it finds are added where
they don't touch a base span; two card numbers side by side are an example,
which the base pattern takes for one number that is too long.

The field is trained here, by the likelihood of a few hundred written lines made
from a seed; no document and no label is used.

Defined results for odd input: a null or empty text has no spans; offsets are
code points, ends exclusive; texts are read whole, in time linear in their
length; a repeated row is searched again; an empty table gives an empty table;
other columns pass through.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
_ORDER = {k: i for i, k in enumerate(KINDS)}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match can't begin inside a number that didn't match from its first digit, so
# looking behind changes no match and keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    end, low, at = 0, 0, text.find("@")
    while at >= 0:  # a local part holds no at-sign, so each stretch between two is looked at once
        low = max(low, end)
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            end = found.end()
        low = at + 1
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """Pattern spans by start and kind; each kind leftmost and non-overlapping."""
    spans: list[Span] = []
    if not text:
        return spans
    if "@" in text:
        spans.extend(_emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(is_octet(p) for p in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]]))


# ---- the field ---------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: What a stretch begins at, and how it goes on: with words that hold a digit, an at-sign or a bracket.
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]")
STRETCH = re.compile(r"(?:(?:@|[\[(]\s?at\s?[\])])[ \t]?)?\S+(?:[ \t]?[\[(]\s?(?:at|dot)\s?[\])][ \t]?\S+)*(?:[ \t]\S*[0-9@(]\S*)*")
AT = re.compile(r"@|[\[(]\s?at\s?[\])]")
AT_WORD = re.compile(r"[\[(]\s?(?:at|dot)\s?[\])]")
NUMERIC = re.compile(r"[0-9+() .\-]+")
SPOKEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]+)+")
#: Words that announce a kind, in four languages.
CUES = {
    "email": frozenset("email mail e-mail correo courriel".split()),
    "ip": frozenset("ip host server address adresse".split()),
    "card": frozenset("card visa mastercard carte karte tarjeta kreditkarte".split()),
    "phone": frozenset("phone tel call telefon téléphone teléfono mobile fax".split()),
}
#: After so many tokens, what all open paths have in common is given out.
SETTLE_TOKENS = 512
#: How many gains of numbers a task remembers.
KNOWN_GAINS = 1 << 17


class Segment:
    __slots__ = ("end", "features", "gain", "kind", "start")

    def __init__(self, start: int, end: int, kind: str, features: list[str], gain: float | None = None) -> None:
        self.start, self.end, self.kind, self.features, self.gain = start, end, kind, features, gain


def _shape(span: str) -> str:
    return "-".join(str(len(g)) for g in NOT_DIGIT.split(span) if g)


def span_features(text: str, start: int, end: int, kind: str, cues: frozenset[str]) -> list[str]:
    """What is seen of a whole candidate span."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"open:{before.isalnum()}", f"close:{after.isalnum()}"]
    out.append(f"joined:{before in ('.', '-', '@', '+', '/') and before != ''}:{after in ('@', '-', '/') and after != ''}")
    if kind in cues:
        out.append("cue")
    if kind == "email":
        out.append(f"spoken:{bool(AT_WORD.search(span))}")
        out.append(f"ats:{min(2, len(AT.findall(span)))}")
        last = re.split(r"[\W_]+", span.rstrip(")] "))[-1]
        out.append(f"ending:{last.isalpha() and 2 <= len(last) <= 6}")
        return [f"{kind}|{f}" for f in out]
    groups = [g for g in NOT_DIGIT.split(span) if g]
    digits = "".join(groups)
    marks = set(span) - set("0123456789")
    if kind == "ip":
        out.append(f"octets:{len(groups) == 4 and all(is_octet(g) for g in groups)}")
        out.append(f"zero:{any(len(g) > 1 and g[0] == '0' for g in groups)}")
    elif kind == "card":
        out.append(f"luhn:{luhn(digits)}")
        out.append(f"length:{len(digits) if len(digits) in (15, 16) else 'other'}")
        out.append(f"even:{len(set(map(len, groups))) == 1 or _shape(span) == '4-6-5'}")
        out.append(f"issuer:{digits[0] in '3456'}")
    else:
        out.append(f"plus:{span[0] == '+'}")
        out.append(f"area:{bool(re.match(r'(?:[+]?[0-9]{1,3}[ -])?[(][0-9]{2,4}[)]', span))}")
        out.append(f"tail:{_shape(span).endswith('3-4')}")
        out.append(f"digits:{'few' if len(digits) < 9 else 'usual' if len(digits) <= 12 else 'many'}")
        out.append(f"groups:{min(len(groups), 6)}")
        out.append(f"round:{span.count('(') == span.count(')')}")
        out.append(f"dots:{'.' in marks}")
    return [f"{kind}|{f}" for f in out]


def _spoken_emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches, found from their at-signs, so that long words cost linear time."""
    end = 0
    for sign in AT.finditer(text):
        if sign.start() < end:
            continue
        before = text[end : sign.start()]
        local = before[:-1] if before[-1:].isspace() else before
        start = end + len(local.rstrip(LOCAL))
        end = sign.end()
        found = SPOKEN_EMAIL.match(text, start) if local[-1:] in LOCAL else None
        if found:
            yield found
            end = found.end()


def candidates(text: str, cuts: list[int], cues: frozenset[str], field: SemiMarkovField | None = None) -> Iterator[Segment]:
    """Spans between token cuts that could be an entity, at most MAX_TOKENS long, by start.

    With a field they carry its scores in place of features, and those that can't be in a best cover are left out.
    """
    place = {c: i for i, c in enumerate(cuts)}
    return heapq.merge(_email_candidates(text, place, cues, field), _numeric_candidates(text, place, cues, field), key=lambda s: s.start)


def _email_candidates(text: str, place: dict[int, int], cues: frozenset[str], field: SemiMarkovField | None) -> Iterator[Segment]:
    for m in _spoken_emails(text):
        if m.start() in place and m.end() in place and place[m.end()] - place[m.start()] <= MAX_TOKENS:
            features = span_features(text, m.start(), m.end(), "email", cues)
            yield Segment(place[m.start()], place[m.end()], "email", features, field and field.gain(features))


#: All digits alike: what the pattern of a number depends on.
FLAT = str.maketrans("123456789", "000000000")


@lru_cache(maxsize=1 << 16)
def kinds_of(shape: str) -> tuple[str, ...]:
    """Which kinds a number of this shape, of at most 19 digits, could be."""
    n, kinds = shape.count("0"), []
    if shape.count(".") == 3 and 4 <= n <= 12 and shape[0] == "0" and re.fullmatch(r"0+(?:\.0+){3}", shape):
        kinds.append("ip")
    if n >= 12 and shape[0] == "0" and re.fullmatch(r"0(?:[ -]?0)+", shape):
        kinds.append("card")
    if 7 <= n <= 15 and re.fullmatch(r"\+?(?:[ .-]?\(?0++\)?)++", shape):
        kinds.append("phone")
    return tuple(kinds)


def _numeric_candidates(text: str, place: dict[int, int], cues: frozenset[str], field: SemiMarkovField | None) -> Iterator[Segment]:
    for m in NUMERIC.finditer(text):
        base, flat = m.start(), m[0].translate(FLAT)
        inside = [i for i in range(len(flat) + 1) if base + i in place]
        digits = [0, *accumulate(c == "0" for c in flat)]
        for i, a in enumerate(inside[:-1]):
            if flat[a] not in "0+(":
                continue
            for b in inside[i + 1 : i + 1 + MAX_TOKENS]:
                n = digits[b] - digits[a]
                if n > 19:
                    break
                if n < 4 or flat[b - 1] != "0":
                    continue
                for kind in kinds_of(flat[a:b]):
                    start, end = base + a, base + b
                    if field is None:
                        yield Segment(place[start], place[end], kind, span_features(text, start, end, kind, cues))
                    elif (gain := field.gain_of_number(text, start, end, kind, cues, flat[a:b])) + field.lead(kind, place[end] - place[start]) >= 0:
                        yield Segment(place[start], place[end], kind, [], gain)


STATES = ("other", *KINDS)


class SemiMarkovField:
    """Segment scores plus a score for each pair of neighbouring states."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((5, 5))
        self.known: dict[tuple, float] = {}
        self.leads: dict[str, float] | None = None

    def _edges(self, tokens: int, segments: list[Segment]) -> list[list[tuple[int, int, float, Segment | None]]]:
        """By end: start, state, score and segment."""
        into: list[list] = [[] for _ in range(tokens + 1)]
        get = self.weights.get
        for t in range(tokens):
            into[t + 1].append((t, 0, 0.0, None))
        for s in segments:
            into[s.end].append((s.start, 1 + _ORDER[s.kind], sum(get(f, 0.0) for f in s.features), s))
        return into

    def gain(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def gain_of_number(self, text: str, start: int, end: int, kind: str, cues: frozenset[str], shape: str) -> float:
        """The gain of a number, computed once for all that have the same features."""
        more: object = None
        if kind == "card":
            digits = NOT_DIGIT.sub("", text[start:end])
            more = luhn(digits), digits[0] in "3456"
        elif kind == "ip":
            groups = text[start:end].split(".")
            more = all(is_octet(g) for g in groups), any(len(g) > 1 and g[0] == "0" for g in groups)
        key = kind, shape, text[start - 1 : start], text[end : end + 1], kind in cues, more
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KNOWN_GAINS:
                self.known.clear()
            found = self.known[key] = self.gain(span_features(text, start, end, kind, cues))
        return found

    def lead(self, kind: str, tokens: int) -> float:
        """What a segment of ``tokens`` tokens can have over tokens of no entity in its place, at most, besides its gain."""
        if self.leads is None:
            p = self.pairs
            self.leads = {k: float((p[:, s] - p[:, 0]).max() + max(0.0, (p[s] - p[0]).max())) for s, k in enumerate(KINDS, 1)}
        return self.leads[kind] - (tokens - 1) * float(self.pairs[0, 0])

    def best(self, tokens: int, segments: Iterable[Segment]) -> Iterator[Segment]:
        """The best cover of all tokens by segments, jointly; its entities, in order.

        ``segments`` come by start and are read as they are needed.  What all open
        paths share is given out on the way, so a very long stretch isn't held.
        """
        coming = iter(segments)
        ahead = next(coming, None)
        if ahead is None:
            return
        pairs = self.pairs.tolist()
        into: dict[int, list[Segment]] = {}
        score: dict[int, list[tuple[int, float]]] = {0: [(0, 0.0)]}  # by position: states that can be reached, and how well
        back: dict[tuple[int, int], tuple[int, int, Segment | None]] = {}
        root = (0, 0)
        for end in range(1, tokens + 1):
            while ahead is not None and ahead.start < end:
                into.setdefault(ahead.end, []).append(ahead)
                ahead = next(coming, None)
            now: dict[int, float] = {}
            edges = [(end - 1, 0, 0.0, None)]
            if end in into:
                edges += [(s.start, 1 + _ORDER[s.kind], self.gain(s.features) if s.gain is None else s.gain, s) for s in into.pop(end)]
            for start, state, gain, segment in edges:
                before, most = -1, -math.inf
                for x, value in score[start]:
                    if value + pairs[x][state] > most:
                        before, most = x, value + pairs[x][state]
                if most + gain > now.get(state, -math.inf):
                    now[state] = most + gain
                    back[end, state] = start, before, segment
            score[end] = sorted(now.items())
            score.pop(end - MAX_TOKENS - 1, None)
            if end % SETTLE_TOKENS == 0:
                live = {(p, s) for p, row in score.items() for s, _ in row}
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last][:2])
                yield from self._between(back, root, root := live.pop())
                back = {node: step for node, step in back.items() if node[0] > root[0]}
        yield from self._between(back, root, (tokens, max(score[tokens], key=lambda x: (x[1], -x[0]))[0]))

    @staticmethod
    def _between(back: dict, root: tuple[int, int], node: tuple[int, int]) -> list[Segment]:
        found = []
        while node != root:
            start, before, segment = back[node]
            if segment:
                found.append(segment)
            node = start, before
        return found[::-1]

    def train(self, examples: list[tuple[int, list[Segment], list[bool]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Stochastic gradient ascent on the likelihood of the right segments."""
        shuffler = random.Random(5)
        for r in range(rounds):
            shuffler.shuffle(examples)
            step = rate / (1 + 0.2 * r)
            for tokens, segments, right in examples:
                self._climb(tokens, segments, right, step, decay)

    def _climb(self, tokens: int, segments: list[Segment], right: list[bool], step: float, decay: float) -> None:
        into = self._edges(tokens, segments)
        out: list[list] = [[] for _ in range(tokens + 1)]
        for end, edges in enumerate(into):
            for start, state, gain, segment in edges:
                out[start].append((end, state, gain, segment))
        ahead, behind = np.full((tokens + 1, 5), -1e30), np.full((tokens + 1, 5), -1e30)
        ahead[0, 0] = 0.0
        behind[tokens] = 0.0
        for end in range(1, tokens + 1):
            for start, state, gain, _ in into[end]:
                ahead[end, state] = np.logaddexp(ahead[end, state], np.logaddexp.reduce(ahead[start] + self.pairs[:, state]) + gain)
        for start in range(tokens - 1, -1, -1):
            for end, state, gain, _ in out[start]:
                behind[start] = np.logaddexp(behind[start], self.pairs[:, state] + gain + behind[end, state])
        total = np.logaddexp.reduce(ahead[tokens])
        gradient = np.zeros((5, 5))
        wanted = {id(s) for s, y in zip(segments, right, strict=True) if y}
        changes: dict[str, float] = {}
        for end in range(1, tokens + 1):
            for start, state, gain, segment in into[end]:
                share = np.exp(ahead[start] + self.pairs[:, state] + gain + behind[end, state] - total)
                gradient[:, state] -= share
                if segment is not None:
                    change = (id(segment) in wanted) - share.sum()
                    for f in segment.features:
                        changes[f] = changes.get(f, 0.0) + change
        at, before = 0, 0
        ends = {s.start: s for s, y in zip(segments, right, strict=True) if y}
        while at < tokens:
            s = ends.get(at)
            state = 1 + _ORDER[s.kind] if s else 0
            gradient[before, state] += 1
            at, before = (s.end if s else at + 1), state
        for f, change in changes.items():
            w = self.weights.get(f, 0.0)
            self.weights[f] = w + step * (change - decay * w)
        self.pairs += step * (gradient - decay * self.pairs)


def _cuts(text: str) -> list[int]:
    return [0, *(m.end() for m in TOKEN.finditer(text))]


def _checked(rng: random.Random, n: int) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def training_lines(seed: int = 11, lines: int = 320) -> list[tuple[str, list[Span], frozenset[str]]]:
    """Invented lines with their spans: all kinds in several forms, and look-alikes."""
    rng = random.Random(seed)
    number = lambda n: str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    name = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def entity(kind: str) -> str:
        if kind == "email":
            user, host, top = name() + rng.choice(["", "." + name(), number(2)]), name(), rng.choice(["com", "org", "net", "de", "fr"])
            return rng.choice([f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user} (at) {host}.{top}", f"{user} @ {host}.{top}"])
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            n = rng.choice([16, 16, 16, 15, 13])
            d, sep = _checked(rng, n), rng.choice(["", "", " ", "-"])
            return sep.join(d[i : i + 4] for i in range(0, n, 4)) if n == 16 else d
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{number(2)} {number(2)} {b} {c}", f"{a}-{b}-{c}", f"+{number(11)}"])

    def lookalike() -> str:
        wrong = number(16)
        while luhn(wrong):
            wrong = number(16)
        return rng.choice([
            wrong, number(12), f"20{number(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{number(1)}.{number(1)}.{number(2)}",
            f"{rng.randint(256, 999)}.{number(3)}.{number(2)}.{number(1)}", number(rng.randint(1, 9)), f"{number(2)},{number(3)},{number(3)}",
            f"{number(4)} {number(4)}", f"{number(5)}-{number(5)}", f"{number(3)} {number(3)} {number(3)}", f"{number(2)}:{number(2)}", f"{number(3)}.{number(2)}",
            f"{number(4)}{name()}{number(6)}", f"{number(1)}-{number(3)}-{number(5)}-{number(1)}", f"{number(20)}", f"{name()}@{name()}", f"{number(7)}", f"{number(10)}",
        ])

    out = []
    for _ in range(lines):
        text, spans, cues = "", [], set()
        for k in range(rng.choice([1, 1, 2, 3])):
            kind = rng.choice([*KINDS, "none", "none"])
            text += " " * (k > 0)
            piece = lookalike() if kind == "none" else entity(kind)
            if kind != "none":
                spans.append((len(text), len(text) + len(piece), kind))
                if k == 0 and rng.random() < 0.25:
                    cues.add(kind)
            text += piece + rng.choice(["", "", "", ",", ".", ";"])
        out.append((text, spans, frozenset(cues)))
    return out


@lru_cache(maxsize=1)
def trained_field() -> SemiMarkovField:
    examples = []
    for text, spans, cues in training_lines():
        cuts = _cuts(text)
        segments = list(candidates(text, cuts, cues))
        wanted = set(spans)
        right = [(cuts[s.start], cuts[s.end], s.kind) in wanted for s in segments]
        examples.append((len(cuts) - 1, segments, right))
    field = SemiMarkovField()
    field.train(examples)
    return field


def cues_before(text: str, at: int) -> frozenset[str]:
    words = {w.strip(".:,;()").lower() for w in text[max(0, at - 24) : at].split()}
    return frozenset(k for k, known in CUES.items() if words & known)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where the field reads: words around digits and at-signs, joined where they neighbour."""
    upto = 0
    for m in TRIGGER.finditer(text):
        if m.start() < upto:
            continue
        before = text[upto : m.start()]
        if before[-1:].isspace() and m[0] != "@" and not m[0].isdigit():
            before = before[:-1]  # a word, a space, and a bracketed stand-in
        elif before[-1:] == " " and m[0] == "@":
            before = before[:-1]
        word = "" if not before or before[-1].isspace() else before.rsplit(None, 1)[-1]
        gap = m.start() - upto - len(before)
        start = m.start() - gap - len(word)
        end = STRETCH.match(text, m.start()).end()
        yield start, end
        upto = end


def field_spans(text: str, field: SemiMarkovField) -> Iterator[Span]:
    """Entities that the field finds, stretch by stretch."""
    for start, end in stretches(text):
        piece = text[start:end]
        cuts = _cuts(piece)
        for s in field.best(len(cuts) - 1, candidates(piece, cuts, cues_before(text, start), field)):
            yield start + cuts[s.start], start + cuts[s.end], s.kind


def find_spans(text: str | None, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if not text:
        return base, base
    out, upto, reached = list(base), 0, 0
    taken = sorted((a, b) for a, b, _ in base)
    i = 0
    for a, b, kind in sorted(field_spans(text, field)):
        while i < len(taken) and taken[i][0] < b:
            reached = max(reached, taken[i][1])
            i += 1
        touches = reached > a
        if a >= upto and not touches:
            out.append((a, b, kind))
            upto = b
    return base, sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


FOUND = "struct<base:array<struct<start:int,end:int,kind:string>>,spans:array<struct<start:int,end:int,kind:string>>>"


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (start, end, kind), which replace columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(trained_field())

    def rows(spans: list[Span]) -> list[dict]:
        return [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    @F.pandas_udf(FOUND)
    def find(column: pd.Series) -> pd.DataFrame:
        found = [find_spans(t, sent.value) for t in column]
        return pd.DataFrame({"base": [rows(b) for b, _ in found], "spans": [rows(s) for _, s in found]})

    out = docs.withColumn("__pii", find(F.col(f"`{text}`")))
    return out.withColumns({"base": F.col("__pii.base"), "spans": F.col("__pii.spans")}).drop("__pii")


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``text`` with every found span replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, found, strict=True):
            parts, at = [], 0
            for s in ss if t else ():
                if s["start"] >= at:
                    parts.append(f"{t[at : s['start']]}[{s['kind'].upper()}]")
                at = max(at, s["end"])
            out.append("".join(parts) + t[at:] if t else t)
        return pd.Series(out)

    return docs.withColumn(text, masked(F.col(f"`{text}`"), F.col(spans)))
