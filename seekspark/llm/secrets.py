"""Secret scans: base patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (assignments, keyword arguments, JSON, YAML, INI, shell exports,
command-line options, in comments too) into pairs of a target name and the literals that its value is made of, over
line ends where brackets, continuations or indentation carry on. Names that are assigned literals are constants,
which are propagated into all values of the text that use them, so a literal counts for every target that it ends
up in. A literal is scored by how sensitive its target's name is and by how much it looks like a secret.

Every step takes time linear in the text (or linear times a logarithm), whatever its lines look like.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seekspark.llm.common import apart

#: The base patterns, in the order of kinds (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of at least 32; shorter runs of the contract's pattern are dropped anyway.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")

#: Parts of a name and how sensitive they are (0 to 1).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "key": 0.5, "private": 0.4, "access": 0.3, "api": 0.3,
    "signing": 0.4, "encryption": 0.4, "session": 0.3, "bearer": 0.8, "salt": 0.5, "cert": 0.4, "pass": 0.7,
}
#: Parts of a name that tell of something about a secret rather than the secret.
HARMLESS = {"id", "name", "file", "path", "url", "uri", "type", "length", "size", "count", "field", "label", "public", "expiry", "ttl", "limit", "max", "min", "prompt", "hint", "regex"}
#: Values that stand for a value.
PLACEHOLDER = re.compile(r"^(?:x{3,}|\*{3,}|\.{3,}|none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|\$\w+)$", re.I)
#: The score from which a literal is a secret.
LEAST = 0.62

_TOKEN = re.compile(
    r"""
    (?P<name>(?:--)?[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z0-9_$]++)*+)
    |(?P<blank>[ \t\r\f\v]++)
    |(?P<line>\\?\n)
    |(?P<quote>"""+'\'{3}|"{3}'+r"""|["'`])
    |(?P<op>:=|=>|==|!=|<=|>=|=|::|:)
    |(?P<open>[(\[{])
    |(?P<close>[)\]}])
    |(?P<sep>[,;])
    |(?P<plus>\+)
    |(?P<mark>//++|\#++)
    |(?P<number>[0-9][A-Za-z0-9_.+/-]*+)
    |(?P<other>.)
    """,
    re.X | re.A | re.S,
)
_OP = re.compile(r"[ \t]*+(:=|=>|=(?![=>])|:(?![:=]))")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_.]*+\Z", re.A)
_KEYED = re.compile(r"[\"']?(?:--)?[A-Za-z_$][\w$.-]*+[\"']?[ \t]*+[:=]", re.A)
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t\r]*\n")
_BLANKS = re.compile(r"[ \t]*+")
_REST = {'"': re.compile(r'(?:[^"\\\n]++|\\.)*+', re.S), "'": re.compile(r"(?:[^'\\\n]++|\\.)*+", re.S), "`": re.compile(r"(?:[^`\\\n]++|\\.)*+", re.S)}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: What a line with an assignment holds: a name before an operator, or an option. Runs of blanks are taken as a whole.
_HINT = re.compile(r"[A-Za-z0-9_\"'$\])][ \t]*+[:=]|--[A-Za-z]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def name_score(name: str) -> float:
    """How sensitive a target's name is: its parts' weights, less if a part tells of something else."""
    parts = [p.lower() for p in _PARTS.findall(name.replace("-", "_"))]
    if not parts:
        return 0.0
    joined = {a + b for a, b in zip(parts, parts[1:])}
    every = {p if p in SENSITIVE else p.removesuffix("s") for p in {*parts, *joined}}
    found = [SENSITIVE[p] for p in every if p in SENSITIVE]
    return (0.3 if HARMLESS & set(parts) else 1.0) * min(1.0, sum(found))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: by length, entropy and the mix of kinds of characters."""
    if PLACEHOLDER.match(value) or " " in value.strip() and len(value) < 20:
        return 0.0
    return _looks(Counter(value))


def _looks(chars: Counter) -> float:
    n = chars.total()
    if n < 6:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    own = "".join(chars)
    kinds = sum(bool(re.search(k, own)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.12 * entropy + 0.12 * kinds + min(n, 24) / 80)


#: A part of a value: (text, start, end), and whether it is a string, a bare word or a name.
Part = tuple[str, int, int, str]


class _Lexer:
    """The (target, parts) pairs of one text, in order."""

    def __init__(self, text: str):
        self.text, self.pairs = text, []
        self.run_end = self.run_sign = -1  # the bare run that was looked at last, and the last '=' or '://' in it
        self.unclosed: dict[str, int] = {}  # a quote sign: it is not closed before this place

    def read(self) -> list[tuple[str, list[Part]]]:
        at = 0
        while m := _HINT.search(self.text, at):
            at = self._statement(max(at, self.text.rfind("\n", at, m.start()) + 1))
        return self.pairs

    def _string(self, quote: str, start: int) -> int:
        """Where the string whose inside begins at ``start`` ends, or -1. A kind of quote that is not closed once
        is not looked for again before the place where that search ended."""
        if start <= self.unclosed.get(quote, -1):
            return -1
        if len(quote) == 3:
            end = self.text.find(quote, start)
            self.unclosed[quote] = len(self.text) if end < 0 else -1
            return end
        end = _REST[quote].match(self.text, start).end()
        if end < len(self.text) and self.text[end] == quote:
            return end
        self.unclosed[quote] = end
        return -1

    def _indent(self, at: int) -> int:
        """Blanks before the first sign of the line that begins at ``at``."""
        return _BLANKS.match(self.text, at).end() - at

    def _block(self, at: int, indent: int) -> int:
        """The end of the lines from ``at`` on that are empty or indented more than ``indent``."""
        end = at
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            inner = self._indent(at)
            if at + inner < stop and inner <= indent:
                break
            at = stop + 1
            if inner > indent:
                end = stop
        return end

    def _bare(self, at: int) -> int:
        """The end of a bare word that is a value as a whole, as in INI, YAML and shells, or -1."""
        if at >= self.run_end:
            m = _BARE.match(self.text, at)
            if not m:
                return -1
            word = m[0]
            self.run_end = m.end()
            self.run_sign = at + max(word.rstrip("=").rfind("="), word.rfind("://"))
            if _IDENTIFIER.match(word):
                self.run_sign = self.run_end
        return -1 if self.run_sign >= at else self.run_end

    def _statement(self, start: int) -> int:
        """Lex from the begin of a line to the end of the line at which nothing is open any more."""
        text, n = self.text, len(self.text)
        pos, line_indent = start, self._indent(start)
        indent = line_indent  # of the target's line
        target, op, parts = None, "", []
        joined = waits = False  # the next part belongs to the value; the value has not begun
        outer: list[str | None] = []  # the targets around open brackets
        last = ""  # kind of the latest token that counts

        def close() -> None:
            nonlocal parts
            if target and parts:
                self.pairs.append((target, parts))
            parts = []

        while pos < n:
            if waits:
                pos = _BLANKS.match(text, pos).end()
                block = _BLOCK.match(text, pos) if op == ":" else None
                if block:
                    end = self._block(block.end(), indent)
                    if end > block.end():
                        parts.append((text[block.end() : end], block.end(), end, "string"))
                    pos, waits, joined = max(end, block.end() - 1), False, False
                    continue
                if pos < n and text[pos] not in "\"'`\n\\([{" and not _KEYED.match(text, pos):
                    end = self._bare(pos)
                    if end > 0:
                        parts.append((text[pos:end], pos, end, "word"))
                        pos, joined, last = end, False, "word"
                        waits = False
                        continue
                waits = pos < n and text[pos] in "\r\n\\"
                if pos == n:
                    break
            m = _TOKEN.match(text, pos)
            kind, at, pos = m.lastgroup, pos, m.end()
            if kind == "blank":
                continue
            if kind == "line":
                ahead = _BLANKS.match(text, pos).end()
                empty = ahead >= n or text[ahead] in "\r\n"
                deeper = ahead - pos > indent or text[ahead : ahead + 1] in ("'", '"')
                # An item of a list under the target.
                item = op == ":" and target and (waits or not outer) and ahead - pos >= indent and text.startswith("- ", ahead)
                if not item and m[0] == "\n" and (empty or not (outer or last == "plus" or text[ahead] == "+" and parts or waits and deeper)):
                    close()
                    return pos
                line_indent = ahead - pos
                if item:
                    close()
                    pos, waits, joined = ahead + 2, True, True
                elif outer and not parts and not waits:
                    last = "line"
                continue
            if kind in ("name", "quote"):
                if kind == "quote":
                    end = self._string(m[0], pos)
                    if end < 0:
                        last = "other"
                        continue
                    own: Part = (text[pos:end], pos, end, "string")
                    pos = end + len(m[0])
                else:
                    own = (m[0], at, pos, "name")
                sign = _OP.match(text, pos)
                option = kind == "name" and own[0].startswith("--") and not sign and text[pos : pos + 1] in (" ", "\t")
                if sign or option:
                    name = own[0].strip("-")
                    typed = sign and sign[1] == "=" and op == ":" and target and not parts and joined
                    if not typed or name_score(name) > name_score(target):
                        close()
                        target = name
                        indent = line_indent
                    op, parts = sign[1] if sign else " ", []
                    pos = sign.end() if sign else pos
                    joined = waits = True
                    last = "op"
                    continue
                if target and (joined or kind == "quote" and last == "quote"):
                    parts.append(own)
                    joined = False
                last, waits = kind, False
                continue
            if kind == "open":
                close()
                outer.append(target)
                # What follows a name is a call or an index, whose arguments are not the target's value.
                target = None if last in ("name", "close") else target
                joined, waits = True, False
            elif kind == "close":
                close()
                target, joined = (outer.pop() if outer else None), False
            elif kind == "sep":
                close()
                target, joined = (outer[-1] if outer and last != "name" else None), True
            elif kind == "plus":
                joined = True
            elif kind == "mark":
                if outer:
                    continue
                close()
                target, joined = None, False
            else:
                joined = waits = False
            last = kind
        close()
        return n


def assignments(text: str) -> list[tuple[str, list[Part]]]:
    """(target, parts) pairs in order."""
    return _Lexer(text).read()


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """The literals that end up in a sensitive target and look like a secret."""
    pairs = assignments(text) if _HINT.search(text) else []
    weights = [name_score(t) for t, _ in pairs]
    if not any(weights):
        return []
    defined: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(pairs):
        # The very last of a dotted name may be used too.
        for n in {name, name.rpartition(".")[2]}:
            defined.setdefault(n, []).append(i)

    def constant(name: str, i: int) -> int | None:
        """The assignment that a use in pair i means: the latest before, else the first after."""
        places = defined.get(name) or defined.get(name.rpartition(".")[2]) or []
        j = places[max(0, bisect_left(places, i) - 1)] if places else i
        return None if j == i else j

    own: list[list[Part]] = []
    uses: list[set[int]] = []
    for i, (_, parts) in enumerate(pairs):
        found = {p[1]: constant(p[0], i) for p in parts if p[3] != "string"}
        uses.append({j for j in found.values() if j is not None})
        own.append([p for p in parts if p[3] == "string" or p[3] == "word" and found[p[1]] is None])
    # A constant is as sensitive as the most sensitive target that it ends up in.
    reached = [False] * len(pairs)
    for i in sorted(range(len(pairs)), key=lambda i: -weights[i]):
        todo = [i]
        while todo:
            j = todo.pop()
            if not reached[j]:
                reached[j], weights[j] = True, max(weights[i], weights[j])
                todo.extend(uses[j])
    score = [0.0] * len(pairs)
    chars: dict[int, Counter] = {}

    def letters(i: int) -> Counter:
        if i not in chars:
            chars[i] = Counter("".join(p[0] for p in own[i]))
        return chars[i]

    for i in range(len(pairs)):
        if not weights[i]:
            continue
        score[i] = max(score[i], literal_score("".join(p[0] for p in own[i])))
        if uses[i]:
            # Parts may be short, so a value is looked at together with the constants that it names.
            both = _looks(sum((letters(j) for j in uses[i]), Counter(letters(i))))
            for j in (i, *uses[i]):
                if not all(PLACEHOLDER.match(p[0]) for p in own[j]):
                    score[j] = max(score[j], both)
    found = set()
    for i, parts in enumerate(own):
        if weights[i] and score[i] >= 0.5 and 0.5 * weights[i] + 0.5 * score[i] >= LEAST:
            found.update(("lexed", a, b) for v, a, b, _ in parts if v)
    return sorted(found, key=lambda x: x[1:])


def all_spans(text: str) -> tuple[list, list]:
    """(base spans, all spans): lexed literals are added where no base span overlaps."""
    base = base_spans(text)
    more = apart(lexed_spans(text), base)
    return base, sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row a document: counts and digest of the base spans, and all spans (code points, end exclusive).

    n_assign, n_access and n_hex count base spans, n_lexed the literals that the lexer adds where no base span
    overlaps. Null and empty texts have none. Rows are scanned each for itself, so repeated rows and null ids do not
    matter; an empty table gives no rows. Only doc_id and text are read and returned, whatever other columns there
    are. Texts of any length are scanned whole, each by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, every = all_spans(text or "")
                n = Counter(k for k, _, _ in every)
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                out.append((doc_id, n["assign"], n["access"], n["hex"], digest, written(every), n["lexed"]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
