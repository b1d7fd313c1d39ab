"""Personal data: base patterns, and a character-level BiLSTM-CRF tagger for the forms that they miss.

The tagger is trained in numpy on generated text with labelled spans (emails, IP addresses, card and phone numbers
in many forms, and look-alikes that are none). It reads overlapping windows around what such a span must hold: a
digit, or @, "(at)" or "dot". Windows around the latter take in the whole words beside them, however long. A span
that the end of a window cuts is joined with its rest in the next one, and what all windows say is reconciled over
the text.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seekspark.llm.common import apart

KINDS = ("email", "ip", "card", "phone")
#: The base patterns (fixed values). Emails are found from each @ instead, see _emails.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match ends with all digits of its last part, so the next can only start where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")
#: The spelled forms of an email's signs.
_AT, _DOT = re.compile(r"\s*[\[(]\s*(?:at|@)\s*[\])]\s*|\s+(?:at|@)\s+", re.I), re.compile(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*|\s+(?:dot|\.)\s+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the pattern local@domain finds, leftmost and non-overlapping, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


# ---- labelled text ----


def _pick(rng: np.random.Generator, items: str | list, n: int | None = None):
    if n is None:
        return items[int(rng.integers(len(items)))]
    return "".join(items[i] for i in rng.integers(len(items), size=n))


def _digits(rng: np.random.Generator, n: int) -> str:
    return _pick(rng, "123456789") + _pick(rng, "0123456789", n - 1) if n else ""


def _word(rng: np.random.Generator) -> str:
    w = _pick(rng, "abcdefghijklmnopqrstuvwxyzéèüöñ" if rng.random() < 0.2 else "etaoinshrdlucmfwypvbgk", int(rng.integers(1, 11)))
    r = rng.random()
    return w.upper() if r < 0.05 else w.capitalize() if r < 0.2 else w


def _email(rng: np.random.Generator) -> str:
    r, letters = rng.random(), "abcdefghijklmnopqrstuvwxyz"
    parts = int(rng.integers(1, 3)) if r > 0.15 else int(rng.integers(3, 25))
    local = _pick(rng, [".", "_", "-", "+", ""]).join(_pick(rng, letters, int(rng.integers(2, 8 if r > 0.15 else 13))) for _ in range(parts))
    local += _pick(rng, ["", _digits(rng, 2), "." + _digits(rng, 2)])
    spelled = rng.random() < 0.25
    at = _pick(rng, [" at ", " at ", "(at)", " (at) ", "[at]", " [at] "] if spelled else ["@", "@", "@", " @ ", "(@)", "[@]"])
    dot = _pick(rng, [" dot ", " dot ", " dot ", "(dot)", "[dot]", " [dot] "] + ["."] * (at != " at ")) if spelled else _pick(rng, [".", ".", ".", " . "]) if at != "@" else "."
    if spelled and dot == " dot " and rng.random() < 0.5:
        local = local.replace(".", dot)
    ends = _pick(rng, ["com", "org", "net", "de", "fr", "example.com", "co.uk"]).replace(".", dot)
    return local + at + dot.join([_pick(rng, letters, int(rng.integers(3, 9 if r > 0.1 else 30))) + _pick(rng, ["", _digits(rng, 1)]), ends])


def _ip(rng: np.random.Generator) -> str:
    parts = [str(int(x)) for x in rng.integers(0, 256, size=4)]
    return _pick(rng, [".", ".", ".", " . ", "[.]"]).join(parts)


def _card(rng: np.random.Generator) -> str:
    groups = _pick(rng, [[4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 1]])
    n = sum(groups)
    body = _pick(rng, "3456") + _pick(rng, "0123456789", n - 2)
    body += next(c for c in "0123456789" if luhn(body + c))
    sep = _pick(rng, ["", " ", "-", ".", "/", "  "])
    out, at = [], 0
    for g in groups:
        out.append(body[at : at + g])
        at += g
    return sep.join(out)


def _phone(rng: np.random.Generator) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _pick(rng, "0123456789", 4)
    cc = str(int(rng.integers(1, 99)))
    return _pick(rng, [f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"00{cc} {a} {b}{c}", f"0{a}/{b}{c}"])


def _other(rng: np.random.Generator) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    return _pick(rng, [
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 32):02}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(0, 24)}:{n(0, 60):02}",
        f"{n(0, 1000)}.{n(0, 100)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"#{n(1, 99999)}", f"${n(1, 999)},{n(100, 999)}.{n(10, 99)}",
        _pick(rng, "0123456789abcdef", n(12, 40)), str(n(1, 10**6)), f"{_word(rng)} dot {_word(rng)}", f"at {n(1, 12)}", f"{_word(rng)} at {_word(rng)}", _pick(rng, "abcdefghijklmnopqrstuvwxyz.-_/", n(20, 150)), f"{n(1, 500)} - {n(1, 500)}", f"{_word(rng)}{n(1, 999)}", f"@{_word(rng)}",
        f"{n(1900, 2100)}/{n(1900, 2100)}", f"{n(1, 200)}:{n(1, 200)}:{n(1, 200)}", f"AKIA{_pick(rng, 'ABCDEFGHJKLMNP234567', 16)}",
        f"{n(1, 99)}%", f"({n(1, 99)})", f"[{n(1, 99)}]", f"{n(1, 10)}-{n(1, 10)}", f"{n(100, 999)}-{n(10, 99)}", f"10.{n(1000, 9999)}/{_word(rng)}.{n(1, 999)}",
    ])


def labelled_text(rng: np.random.Generator, length: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Text of at least ``length`` characters and its spans (kind's number, start, end)."""
    makers = (_email, _ip, _card, _phone)
    out, spans, at = [], [], 0
    plain = _pick(rng, [0.3, 0.6, 0.9])
    while at < length:
        r = rng.random()
        if r < 0.16:
            kind = int(rng.integers(4))
            own = makers[kind](rng)
            spans.append((kind, at, at + len(own)))
        elif r < 0.28:
            own = _other(rng)
        else:
            own = _word(rng)
        after = " " if rng.random() < plain else _pick(rng, [" ", ". ", ", ", "\n", "### ", "; ", " | "])
        out.append(own + after)
        at += len(own) + len(after)
    return "".join(out), spans


# ---- the tagger ----

#: Characters with a class of their own, after: other, digit, lower, upper, and those of the words "at" and "dot".
SIGNS = " \n.,-()+@_%:;/#$[]|\"'=&*"
CLASSES, TAGS = 6 + len(SIGNS), 1 + 2 * len(KINDS)
_CLASS = np.zeros(128, np.int64)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3
for _i, _c in enumerate(SIGNS):
    _CLASS[ord(_c)] = 6 + _i
_SPELLED = re.compile(r"\b(?:(at)|dot)\b", re.I)
#: Characters of a window, and between the starts of two; what a window must hold around a digit.
WINDOW, STRIDE, AROUND = 96, 48, 24
#: Lengths of the windows around signs of an email; one that is longer still is cut into windows of the last length,
#: half of it apart. An address has at most 254 characters.
LADDER = (96, 128, 192, 256, 384, 512)
#: What an email must hold, and how far before and after it the words belong to the window.
SIGN = re.compile(r"@|\bdot\b|[\[(]at[\])]", re.I)
BEFORE, AFTER = 56, 64
BARRED = -1e4


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 128, _CLASS[np.minimum(points, 127)], 2)
    for m in _SPELLED.finditer(text):
        out[m.start() : m.end()] = 4 if m[1] else 5
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: 0 is outside, 1 + 2 kind begins a span, 2 + 2 kind goes on in one."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs over character classes, one in each direction, an output layer and CRF transitions."""

    def __init__(self, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, f = hidden, np.float32
        self.hidden, self.losses = hidden, []
        self.p = {
            "out": (rng.standard_normal((2 * n, TAGS)) * 0.1).astype(f),
            "bias": np.zeros(TAGS, f),
            "trans": np.zeros((TAGS, TAGS), f),
            "x": (rng.standard_normal((2, CLASSES, 4 * n)) * 0.3).astype(f),  # a class's input to the gates, by direction
            "h": (rng.standard_normal((2, n, 4 * n)) / n**0.5).astype(f),
        }
        self.p["x"][:, :, n : 2 * n] += 1  # forget gates start open
        self.barred = np.where(allowed(), 0, BARRED).astype(f)
        self.start = np.where(np.arange(TAGS) % 2 == 0, BARRED, 0).astype(f)
        self.start[0] = 0

    def _lstm(self, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """(T, 2, B, hidden) states for classes (T, B), the second direction from the end, and what going back needs."""
        n, (steps, rows) = self.hidden, c.shape
        both, wx, wh = np.stack((c, c[::-1]), axis=1), self.p["x"], self.p["h"]
        way = np.arange(2)[:, None]
        h = cell = np.zeros((2, rows, n), wh.dtype)
        out, tape = np.zeros((steps, 2, rows, n), wh.dtype), []
        for t in range(steps):
            z = wx[way, both[t]] + h @ wh
            gates = _sig(z[:, :, : 3 * n])
            i, f, o, g = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :], np.tanh(z[:, :, 3 * n :])
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((h, cell, i, f, o, g, tanh))
            h, cell = o * tanh, new
            out[t] = h
        return out, tape

    def _lstm_back(self, c: np.ndarray, tape: list, grad: np.ndarray, into: dict) -> None:
        """The gradients of the LSTMs' weights, from those of their states (T, 2, B, hidden)."""
        n, wh = self.hidden, self.p["h"]
        gh, every = np.zeros_like(wh), np.zeros((*grad.shape[:3], 4 * n), wh.dtype)
        dh = dc = np.zeros_like(grad[0])
        back = wh.transpose(0, 2, 1)
        for t in range(len(c) - 1, -1, -1):
            h, cell, i, f, o, g, tanh = tape[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tanh * tanh)
            dz = np.concatenate((dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)), axis=2)
            every[t] = dz
            gh += h.transpose(0, 2, 1) @ dz
            dh, dc = dz @ back, dc * f
        into["h"], into["x"] = gh, np.zeros_like(self.p["x"])
        for way, own in enumerate((c, c[::-1])):
            one_hot = (own.reshape(-1) == np.arange(CLASSES)[:, None]).astype(wh.dtype)
            into["x"][way] = one_hot @ every[:, way].reshape(-1, 4 * n)

    def emissions(self, c: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """(T, B, TAGS) scores of tags for classes (T, B)."""
        states, tape = self._lstm(c, keep)
        both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, tape)

    def _chain(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward and backward weights of tags, scaled at each step so that their product is the tag's probability;
        the weights of tags and transitions; the scales; and the log of the sum over all paths."""
        w, top = np.exp(self.p["trans"] + self.barred), e.max(axis=2)
        q = np.exp(e - top[:, :, None])
        a, b, scale = np.zeros_like(e), np.ones_like(e), np.zeros_like(top)
        now = q[0] * np.exp(self.start)
        for t in range(len(e)):
            now = now if t == 0 else (now @ w) * q[t]
            scale[t] = now.sum(axis=1)
            now = now / scale[t][:, None]
            a[t] = now
        back = w.T
        for t in range(len(e) - 1, 0, -1):
            b[t - 1] = (q[t] * b[t]) @ back / scale[t][:, None]
        return a, b, q, w, scale, (np.log(scale) + top).sum(axis=0)

    def loss(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (T, B), and its gradients."""
        e, (both, tape) = self.emissions(c, True)
        a, b, q, w, scale, z = self._chain(e)
        gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=0) + (self.p["trans"] + self.barred)[y[:-1], y[1:]].sum(axis=0)
        n = c.size
        de = a * b
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        trans = w * (a[:-1].reshape(-1, TAGS).T @ (q[1:] * b[1:] / scale[1:, :, None]).reshape(-1, TAGS))
        np.add.at(trans, (y[:-1].ravel(), y[1:].ravel()), -1)
        de, grads = de / n, {"trans": trans / n}
        grads["out"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        grads["bias"] = de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        self._lstm_back(c, tape, np.stack((dh[:, :, : self.hidden], dh[::-1, :, self.hidden :]), axis=1), grads)
        return float((z - gold).sum() / n), grads

    def train(self, steps: int, pool: int = 1500, rate: float = 0.03, seed: int = 11) -> "Tagger":
        """Adam with a falling rate, on random stretches of ``pool`` labelled texts: mostly short ones, each fourth
        step fewer and longer ones."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        texts = []
        for _ in range(pool):
            text, spans = labelled_text(rng, 320)
            tags = np.zeros(len(text), np.int64)
            for kind, s, t in spans:
                tags[s], tags[s + 1 : t] = 1 + 2 * kind, 2 + 2 * kind
            texts.append((classes(text), tags))
        for step in range(1, steps + 1):
            length, batch = (288, 16) if step % 4 == 0 else (72, 64)
            c, y = np.zeros((length, batch), np.int64), np.zeros((length, batch), np.int64)
            for j in range(batch):
                own, tags = texts[int(rng.integers(pool))]
                shift = int(rng.integers(len(own) - length + 1))
                c[:, j], y[:, j] = own[shift : shift + length], tags[shift : shift + length]
                if y[0, j] and y[0, j] % 2 == 0:  # a span that is cut at the start begins there
                    y[0, j] -= 1
            loss, grads = self.loss(c, y)
            norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
            now = rate * (1 - (step - 1) / steps)
            for k, g in grads.items():
                g = g * min(1.0, 0.2 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            self.losses.append(loss)
        return self

    def decode(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (T, B) for classes (T, B), and each one's probability."""
        e, _ = self.emissions(c)
        w = self.p["trans"] + self.barred
        best, back = e[0] + self.start, []
        for t in range(1, len(e)):
            x = best[:, :, None] + w
            back.append(x.argmax(axis=1))
            best = x.max(axis=1) + e[t]
        tags = np.zeros(c.shape, np.int64)
        rows = np.arange(c.shape[1])
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 2, -1, -1):
            tags[t] = back[t][rows, tags[t + 1]]
        a, b, *_ = self._chain(e)
        return tags, np.take_along_axis(a * b, tags[:, :, None], 2)[:, :, 0]


#: Training steps; each has 64 stretches of text of 72 characters, or 16 of 288.
STEPS = 600
#: A span's mean tag probability, at least.
SURE = 0.75


_trained: dict[int, Tagger] = {}


def trained(spark: SparkSession, steps: int = STEPS) -> Tagger:
    """The tagger. Its training text is generated, so it is the same in every run, and it is made once a driver.

    It is trained in a task: there numpy keeps to the task's cores, and if the executor is lost, another does it.
    """
    if steps not in _trained:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tagger().train(steps))])], ["tagger"])

        _trained[steps] = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "tagger binary").first()["tagger"])
    return _trained[steps]


#: A window: where it starts and ends, its length as decoded, and whether it goes on from the one before.
Window = tuple[int, int, int, bool]


def _covered(stretches: list[list[int]], lengths: tuple[int, ...], n: int) -> list[Window]:
    out = []
    for a, b in stretches:
        length = next((x for x in lengths if x >= b - a), lengths[-1])
        for s in range(a, max(a + 1, b - length // 2), length // 2):
            out.append((s, min(n, s + length), length, s > a))
    return out


def _windows(text: str) -> list[Window]:
    """Windows over all stretches near a digit, and over the words around all signs of an email."""
    n = len(text)
    digits: list[list[int]] = []
    for m in re.finditer(r"[0-9]+", text):
        a, b = max(0, m.start() - AROUND), min(n, m.end() + AROUND)
        if digits and a <= digits[-1][1]:
            digits[-1][1] = b
        else:
            digits.append([a, b])
    signs: list[list[int]] = []
    for m in SIGN.finditer(text):
        free, at, end = signs[-1][1] if signs else 0, m.start(), m.end() + AFTER
        if signs and end <= free:
            continue
        # To the borders of the words there; each part of the text is looked through once.
        stop = _SPACE.search(text, min(end, n))
        end = min(n, (stop.start() if stop else n) + AROUND)
        if signs and at - BEFORE <= free:
            signs[-1][1] = end
        else:
            begin = max([free, *(text.rfind(c, free, at - BEFORE) for c in " \n\t\r")]) if at > BEFORE else 0
            begin = max(0, begin - AROUND)
            if signs and begin <= free:
                signs[-1][1] = end
            else:
                signs.append([begin, end])
    return _covered(digits, (WINDOW,), n) + _covered(signs, LADDER, n)


def _plausible(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a decoded span can be of its kind at all; it must not be cut out of a longer word or number."""
    own = text[a:b]
    if a and (text[a - 1].isalnum() or text[a - 1] in "_@#$-") or b < len(text) and (text[b].isalnum() or text[b] in "_@"):
        return False
    digits = re.sub("[^0-9]", "", own)
    if kind == "email":
        left, at, right = _DOT.sub(".", _AT.sub("@", own)).partition("@")
        return bool(at and re.search(r"[A-Za-z0-9]\W*\Z", left) and re.search(r"[A-Za-z0-9]\.[A-Za-z]{2,}\Z", right) and not _SPACE.search(left + right))
    if re.search(r"[^0-9\x20().+/\[\]-]", own) or not own[-1].isdigit():
        return False
    if kind == "ip":
        parts = re.split(r"[^0-9]+", own)
        return len(parts) == 4 and "." in own and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(re.split(r"[^0-9]+", own.strip("+("))) >= 2


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of the spans of all windows of a text, those that do not overlap and together weigh most.

    A span's weight is its surest probability times its length; the choice is weighted interval scheduling.
    """
    sure: dict[tuple[str, int, int], float] = {}
    for kind, a, b, p in found:
        sure[kind, a, b] = max(p, sure.get((kind, a, b), 0.0))
    items = sorted(sure.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [k[2] for k, _ in items]
    took: list[tuple[float, int | None, int]] = [(0.0, None, 0)]
    for i, ((_, a, b), p) in enumerate(items):
        before = bisect_right(ends, a, 0, i)
        weight = took[before][0] + p * (b - a)
        took.append((weight, i, before) if weight > took[-1][0] else (took[-1][0], None, i))
    out, at = [], len(took) - 1
    while at > 0:
        _, i, before = took[at]
        if i is not None:
            out.append(items[i][0])
        at = before
    return out[::-1]


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text, reconciled over its windows."""
    jobs = [(i, *w) for i, t in enumerate(texts) for w in _windows(t)]
    runs: list[list[tuple[int, int, int, float]]] = [[] for _ in jobs]  # (tag, start, end, sum of probabilities)
    for length in sorted({j[3] for j in jobs}):
        like = [k for k, j in enumerate(jobs) if j[3] == length]
        size = 49152 // length
        for at in range(0, len(like), size):
            own = like[at : at + size]
            c = np.full((length, len(own)), _CLASS[10], np.int64)
            for j, k in enumerate(own):
                i, a, b = jobs[k][:3]
                c[: b - a, j] = classes(texts[i][a:b])
            tags, p = tagger.decode(c)
            for j, k in enumerate(own):
                a, b = jobs[k][1:3]
                col = tags[: b - a, j]
                for s in np.flatnonzero(col % 2 == 1).tolist():
                    e = s + 1
                    while e < b - a and col[e] == col[s] + 1:
                        e += 1
                    runs[k].append((int(col[s]), a + s, a + e, float(p[s:e, j].sum())))
    found: list[list] = [[] for _ in texts]
    cut: tuple[int, int, int, float] | None = None  # the span that the end of the window before cut
    for (i, a, b, _, follows), own in zip(jobs, runs):
        before, cut = cut if follows else None, None
        for tag, s, e, p in own:
            if s == a and a > 0:
                if not before or before[0] != tag or before[1] >= a:
                    continue
                # The part in both windows counts by what the later one says.
                s, p = before[1], before[3] * (s - before[1]) / (before[2] - before[1]) + p
            if e == b and b < len(texts[i]):
                cut = (tag, s, e, p)
                continue
            kind = KINDS[(tag - 1) // 2]
            if p / (e - s) >= SURE and _plausible(kind, texts[i], s, e):
                found[i].append((kind, s, e, p / (e - s)))
    return [reconciled(f) if f else [] for f in found]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_tagged long"
)


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """A row a document: counts and digest of the base spans, and all spans (code points, end exclusive).

    Tagged spans are added where they overlap no base span. Null and empty texts have none. Rows are read each for
    itself, so repeated rows and null ids do not matter; an empty table gives no rows. Only doc_id and text are read
    and returned, whatever other columns there are. Texts of any length are read whole, each by one task.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tagger or trained(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                out = []
                for doc_id, text, tagged in zip(b.column(0).to_pylist(), texts, tagged_spans(texts, sent.value)):
                    base = base_spans(text)
                    more = apart(tagged, base)
                    every = sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                    n = Counter(k for k, _, _ in base)
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    out.append((doc_id, *[n[k] for k in KINDS], digest, written(every), len(more)))
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
