"""Personal data: generators propose spans, boosted trees judge them.

*Base* spans follow fixed formats and always count. Beside them, generators of high
recall propose spans in looser formats (masked addresses, numbers without a plus
sign, other separators, IPv6); proposals may overlap. A gradient-boosted ensemble of
trees scores each by its format and its context; the score is calibrated on
examples held out, and for each kind a span is redacted if its probability reaches
the threshold at which the examples held out show the wanted precision. Of overlapping
spans that pass, the most probable stays (ties: the longest, then the first, then by kind);
none may overlap a base span.

The examples are made here, by a seeded generator of sentences that hold personal
data and look-alikes (dates, prices, versions, order numbers); their number is
``EXAMPLES``. Nothing is fitted to the input, so results don't depend on its size.

Null and empty texts have no spans, empty tables no rows. Positions count code points;
repeated rows are judged alike; a span depends on the 40 characters before it and the
two behind it, on nothing further away. Texts of any length are searched whole, in time
linear in the text. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from harrier.llm.common import map_rows, text_of

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 6_000
PRECISION = 0.99
TREES, DEPTH, RATE = 60, 3, 0.2

Span = tuple[int, int, str]

#: An address from its @ on; what stands before it is found by walking back.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits can hold a match only from its start, so looking back loses none.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What any span holds: a digit, an @, the word "at", or two colons with at most four letters between.
_ANY = re.compile(r"[0-9@]|\b[aA][tT]\b|:[A-Fa-f]{0,4}:")


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The spans in fixed formats, by start and then kind as listed."""
    out: list[Span] = []
    free = 0
    for m in _AFTER_AT.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end(), "email"))
            free = m.end()
    out.extend((m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split("."))))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out.extend((m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Generators of proposals: high recall, little precision.
_PROPOSALS = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}){3}(?![0-9])", re.I)),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./_-]{1,3}[0-9]{3,6}){2,4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9(])\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])00[0-9]{1,3}[ ./-](?:[0-9]{2,4}[ ./-]?){2,4}[0-9]{2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])0[0-9]{2,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5})?(?![0-9])")),
]
#: Words that make a kind likely, or unlikely, just before the span.
_CUES = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I),
    "ip": re.compile(r"\bip|host|server|addr|login|ping", re.I),
    "card": re.compile(r"card|visa|amex|master|credit|debit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|dial", re.I),
}
_AGAINST = re.compile(r"order|invoice|isbn|version|serial|ref|\bno\.|ticket|sku|meet|arrive|look|\$|€|#|part|build|case", re.I)
_ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "co"}


def proposals(text: str) -> Iterator[Span]:
    """All candidates of all generators; they may overlap."""
    for kind, pattern in _PROPOSALS:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind


def features(text: str, span: Span) -> list[float]:
    """What the trees see of a candidate: its format, then its context."""
    start, end, kind = span
    body = text[start:end]
    digits = "".join(c for c in body if "0" <= c <= "9")
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    groups = re.findall(r"[0-9]+", body)
    last = re.split(r"[^A-Za-z0-9]+", body)[-1].lower()
    return [
        float(KINDS.index(kind)),
        float(len(body)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len({len(g) for g in groups})),
        float(sum(c.isalpha() for c in body)),
        float(len({c for c in body if not c.isalnum()})),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(int(digits[0]) if digits else -1),
        float(len(set(digits))),
        float(all(_small(g) for g in groups) if groups else 0),
        float(body.count(":")),
        float("::" in body),
        float(body.startswith(("(", "00"))),
        float(last in _ENDINGS),
        float(bool(re.search(r"[\[({<](?:at|dot|\.)[\])}>]", body, re.I))),
        float(bool(_CUES[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        # the number goes on beyond the span
        float(bool(re.fullmatch(r"[./_-][0-9]", after))),
        float(bool(re.search(r"[0-9][./_-]$", before))),
    ]


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence, with the spans of what personal data it holds."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "re", "th", "in", "es", "on", "ti", "ba", "mo", "lu", "ke", "so")) for _ in range(rng.randint(1, 4)))

    def card(n: int) -> str:
        stem = rng.choice("3456") + digit(n - 2)
        return next(stem + c for c in "0123456789" if luhn(stem + c))

    def email() -> str:
        at = rng.choice(("(at)", "[at]", " [at] ", " (at) ", " at ", "@"))
        dot = rng.choice((" dot ", "[dot]", "(dot)", " [dot] ")) if at in (" at ", "@") else rng.choice((".", "[dot]", " dot ", "(dot)", " (dot) "))
        return f"{word()}{rng.choice(('', '.', '_'))}{digit(rng.randint(0, 2))}{at}{word()}{dot}{rng.choice(sorted(_ENDINGS))}"

    def number() -> str:
        return rng.choice((f"({digit(3)}) 555-{digit(4)}", f"{rng.randint(201, 989)}-{digit(3)}-{digit(4)}", f"{rng.randint(201, 989)}.{digit(3)}.{digit(4)}", f"00{rng.randint(31, 49)} {digit(3)} {digit(3)} {digit(3)}", f"0{digit(3)} {digit(7)}", f"0{digit(3)} {digit(3)} {digit(4)}", f"0{digit(2)} {digit(4)} {digit(4)}", f"0{digit(2)} {digit(7)}", f"0{digit(4)} {digit(6)}", f"0{digit(2)}/{digit(8)}"))

    def spaced(body: str) -> str:
        sep = rng.choice((".", "/", "_", " ", "-", " - "))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    personal = {
        "email": email,
        "ip": lambda: rng.choice((":".join(f"{rng.getrandbits(16):x}" for _ in range(8)), f"2001:db8::{rng.getrandbits(16):x}:{rng.getrandbits(12):x}", "[.]".join(str(rng.randint(1, 255)) for _ in range(4)))),
        "card": lambda: spaced(card(16)) if rng.random() < 0.7 else card(13),
        "phone": number,
    }
    alike = [
        lambda: f"at {word()} {rng.choice(('in', 'the', 'and'))} {word()}",
        lambda: f"{word()} at {word()}. {word().title()} {word()}",
        lambda: f"{word()} looked at {word()}.{word()}",
        lambda: f"{rng.randint(0, 23):02d}:{digit(2)}:{digit(2)}",
        lambda: ":".join(f"{rng.getrandbits(8):02x}" for _ in range(6)),
        lambda: f"{digit(3)}.{digit(3)}.{digit(4)}.{digit(3)}",
        lambda: f"{rng.randint(1990, 2030)}-{digit(2)}-{digit(2)}",
        lambda: f"{digit(3)}-{digit(3)}-{digit(5)}",
        lambda: f"order {digit(16)}",
        lambda: f"isbn {digit(3)}-{digit(4)}-{digit(4)}-{digit(4)}",
        lambda: f"{digit(rng.randint(13, 19))}",
        lambda: f"version {digit(1)}.{digit(2)}.{digit(3)}",
        lambda: f"ref {digit(4)} {digit(4)} {digit(4)} {digit(4)}",
        lambda: f"{digit(3)}, {digit(3)}, {digit(4)}",
        lambda: f"part 0{digit(3)} {digit(6)}",
        lambda: f"ticket {digit(3)}-{digit(3)}-{digit(4)}",
        lambda: f"{word()}::{word()}",
        lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}",
    ]
    cue = {"email": ("mail", "contact", "write to"), "ip": ("host", "ip", "server"), "card": ("card", "visa", "pay with"), "phone": ("call", "phone", "tel")}
    text, spans = f"{word()} {word()} ", []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            body = personal[kind]()
            text += f"{rng.choice(cue[kind]) if rng.random() < 0.6 else word()} "
            spans.append((len(text), len(text) + len(body), kind))
        else:
            body = rng.choice(alike)()
        text += f"{body} {word()}{rng.choice(('.', ',', ''))} {word()} "
    return text, spans


def examples(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates of ``n`` sentences. A candidate is right
    if it covers a span of its kind and reaches at most two characters beyond."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(n):
        text, truth = example(rng)
        base = base_spans(text)
        for span in proposals(text):
            if not any(span[0] < e and s < span[1] for s, e, _ in base):
                xs.append(features(text, span))
                ys.append(any(k == span[2] and span[0] <= s and e <= span[1] and span[1] - span[0] <= e - s + 2 for s, e, k in truth))
    return np.array(xs), np.array(ys, float)


class BoostedTrees:
    """Gradient boosting of the logistic loss with small trees over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 24):
        self.n_trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.start = 0.0
        #: Nodes of a tree: (feature, cut, left, right), or (-1, value, 0, 0).
        self.trees: list[list[tuple[int, float, int, int]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        score = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, int, int]] = []
            step = np.zeros(len(y))
            self._grow(tree, x, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth, step)
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, tree, x, cuts, gradient, weight, rows, depth, step) -> int:
        at = len(tree)
        tree.append((-1, 0.0, 0, 0))
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, -1, 0.0)
        if depth and len(rows) >= 20:
            for f, own in enumerate(cuts):
                column = x[rows, f]
                for cut in own:
                    left = column <= cut
                    if 10 <= left.sum() <= len(rows) - 10:
                        gl, hl = gradient[rows][left].sum(), weight[rows][left].sum()
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if gain > best[0]:
                            best = (gain, f, float(cut))
        if best[1] < 0:
            value = self.rate * g / (h + 1)
            tree[at] = (-1, float(value), 0, 0)
            step[rows] = value
            return at
        _, f, cut = best
        left = x[rows, f] <= cut
        a = self._grow(tree, x, cuts, gradient, weight, rows[left], depth - 1, step)
        b = self._grow(tree, x, cuts, gradient, weight, rows[~left], depth - 1, step)
        tree[at] = (f, cut, a, b)
        return at

    def score(self, row: list[float]) -> float:
        total = self.start
        for tree in self.trees:
            f, cut, a, b = tree[0]
            while f >= 0:
                f, cut, a, b = tree[a if row[f] <= cut else b]
            total += cut
        return total


class Detector:
    """The fitted trees with their calibration and thresholds."""

    def __init__(self, n: int = EXAMPLES, precision: float = PRECISION):
        self.trees = BoostedTrees().fit(*examples(n, seed=1))
        x, y = examples(n // 2, seed=2)
        scores = np.array([self.trees.score(row) for row in x.tolist()])
        self.slope, self.shift = self._platt(scores, y)
        p = np.array([self.probability(s) for s in scores])
        self.thresholds = {}
        for i, kind in enumerate(KINDS):
            own = x[:, 0] == i
            self.thresholds[kind] = self._threshold(p[own], y[own], precision)

    @staticmethod
    def _platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of the logistic curve through the held-out scores (Newton)."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * scores + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((y - p) * scores).sum() - 1e-3 * (a - 1), (y - p).sum()])
            hess = np.array([[(w * scores**2).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum()]])
            move = np.linalg.solve(hess, grad)
            a, b = a + move[0], b + move[1]
            if abs(move).max() < 1e-9:
                break
        return float(a), float(b)

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The lowest probability from which on the precision is as wanted; 0.9 at least."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        return max(0.9, float(p[order][good[-1]])) if len(good) else 1.01

    def probability(self, score: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * score + self.shift))))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and added spans."""
        if not _ANY.search(text):
            return [], []
        base = base_spans(text)
        passed = []
        for span in set(proposals(text)):
            if not any(span[0] < e and s < span[1] for s, e, _ in base):
                p = self.probability(self.trees.score(features(text, span)))
                if p >= self.thresholds[span[2]]:
                    passed.append((-p, span[0] - span[1], span))
        added: list[Span] = []
        for _, _, span in sorted(passed):
            if not any(span[0] < e and s < span[1] for s, e, _ in added):
                added.append(span)
        return base, added


@lru_cache(maxsize=1)
def detector() -> Detector:
    """The detector: fitted once in a process, and the same in all of them."""
    return Detector()


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans count as one."""
    out, at = [], 0
    for start, end, kind in ordered(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, spans)``: the redacted text, and what was redacted."""
    model = docs.sparkSession.sparkContext.broadcast(detector())

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in values:
            base, added = model.value.spans(text)
            yield key, redacted(text, base + added), [{"kind": k, "start": s, "end": e} for s, e, k in ordered(base + added)]

    return map_rows(docs, [docs[id_col], text_of(text_col)], rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, spans array<struct<kind:string,start:int,end:int>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row."""
    model = docs.sparkSession.sparkContext.broadcast(detector())

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in values:
            base, added = model.value.spans(text)
            counts = [sum(k == kind for *_, k in base) for kind in KINDS]
            yield key, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)

    return map_rows(docs, [docs["doc_id"], text_of()], rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
