"""Secrets in text: fixed patterns, and literals that the text's own syntax assigns to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import read

KINDS = ("assign", "access", "hex", "lexed")
_BLANK = r"\x20*"
_ASSIGN = re.compile(rf"((?i:password|passwd|secret|token|api_?key))[\"']?{_BLANK}[:=]{_BLANK}[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ASSIGN_ROOTS = ("password", "passwd", "secret", "token", "api")
#: AKIA and at least 16 more, and runs of at least 24: a shorter match of the open-ended patterns holds no match long enough.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Kind, pattern, group that is measured, least length.
PATTERNS = (("assign", _ASSIGN, 2, 6), ("access", _ACCESS, 0, 20), ("hex", _HEX, 0, 24))

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
#: A target and its separator, wherever one can stand: an element with its text, a key and a value attribute, a password field, what a
#: header, an address or a statement carries by its form, a macro, an option, a name and a value as a call's arguments, names and values in
#: a row, a quoted or subscripted key, a name, or a setter's name before its bracket.
_TARGET = re.compile(
    rf"""<(?P<tag>{_NAME})(?:[ \t][^<>\n]*+)?>(?P<body>[^<>]*+)</(?P=tag)>
      |<input\b(?=[^<>\n]*\btype[ \t]*=[ \t]*["']?(?P<input>password))[^<>\n]*?\bvalue[ \t]*+=[ \t]*+(?=["'])
      |(?<![A-Za-z0-9_.-])(?:name|key|id)[ \t]*+=[ \t]*+(?P<aq>["'])(?P<attribute>[^"'<>\n]*+)(?P=aq)\s++value[ \t]*+=[ \t]*+(?=["'])
      |(?i:authorization)["']?[ \t]*+[:=][ \t]*+["']?(?i:bearer|basic|token)[ \t]++(?P<bearer>[A-Za-z0-9_/+.~-]++=*+)
      |(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@"'<>]*+:(?P<address>[^\s/@"'<>$]++)@
      |(?i:\bidentified[ \t]++by[ \t]++(?:password[ \t]++)?)(?P<statement>)(?=["'])
      |\#[ \t]*+define[ \t]++(?P<macro>{_NAME})[ \t]++(?=["'])
      |(?<!\S)--(?P<option>[A-Za-z][A-Za-z0-9_-]*+)(?:=|[ \t]++)(?=[^\s-])
      |(?<![A-Za-z0-9_])(?:define|put|add|set[A-Za-z_]*+)\([ \t]*+(?P<cq>["'])(?P<pair>{_NAME})(?P=cq)[ \t]*+,[ \t]*+(?=["'])
      |(?<![A-Za-z0-9_.,-])(?P<row>{_NAME}(?:[ \t]*+,[ \t]*+{_NAME})++)[ \t]*+(?::=|=(?![=~>]))
      |(?P<q>["'`])(?P<key>[^"'`\n\\]++)(?P=q)[ \t]*+\]?[ \t]*+(?:=>|:=|:(?!:)|=(?![=~>]))
      |(?<![A-Za-z0-9_.-])(?P<name>{_NAME})[ \t]*+(?:=>|:=|(?P<more>\+=)|(?P<colon>:)(?!:)|=(?![=~>]))
      |(?<![A-Za-z0-9_.-])(?P<setter>(?:[A-Za-z0-9_.-]*\.)?set_?[A-Za-z0-9_]++)\((?=[ \t]*["'])""",
    re.VERBOSE,
)
#: Targets whose value stands in the match itself, and the name that they stand for.
_CARRIED = {"bearer": "bearer_token", "address": "password"}
#: Keys that say nothing by themselves: what they hold is the value of the key that they lie under.
_NESTED = {"value", "default", "data", "plain", "content", "text", "string"}
#: What a value may be made of: literals with a prefix or without, a name that holds one, or a bare value.
_ATOM = re.compile(
    r"""(?P<prefix>[A-Za-z]{0,2})(?:\"{3}(?P<td>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<ts>(?:[^'\\]|\\.|'(?!''))*+)'{3}
          |"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>[^`]*+)`)
      |\$\{?(?P<variable>[A-Za-z_][A-Za-z0-9_]*+)\}?
      |(?P<bare>[A-Za-z0-9_/.-]++(?:\+[A-Za-z0-9_/.-]++)*+(?:==?(?=[\s,;)\]}&<]|\Z))?)""",
    re.VERBOSE | re.DOTALL,
)
_BODIES = ("td", "ts", "dq", "sq", "bq")
_GAP = re.compile(r"[ \t]*+")
_WIDE_GAP = re.compile(r"(?:[ \t\r\n]|\\\r?\n)*+")
_JOIN = re.compile(r"(?:[ \t]|\\\r?\n)*+(?:[+%][ \t]*+(?:\\?\r?\n[ \t]*+|\((?=[\"']))?|(?=[\"']))")
_WIDE_JOIN = re.compile(r"[ \t\r\n]*+(?:[+%][ \t\r\n]*+|(?=[\"']))")
#: Codes of a format literal, the bracket of a join's list, a call that looks a name up with or without a value in its place, what
#: stands between a lookup and such a value, and the head of a here-document.
_CODES = re.compile(r"%[-#0-9.]*[a-zA-Z]|\{[^{}]*\}")
_JOINED = re.compile(r"\.join\([ \t\r\n]*+[\[(]")
_COMMA = re.compile(r"[ \t\r\n]*+,[ \t\r\n]*+")
_LOOKUP = re.compile(r"\([ \t]*+([\"'])[^\"'\n]*+\1[ \t]*+(?:,[ \t]*+(?:default[ \t]*+=[ \t]*+)?(?=[\"'])|\)[ \t]*+(?:or|\|\||\?\?|\?:)[ \t]*+(?=[\"']))")
_LOOKS_UP = re.compile(r"(?i)(?:.*[._])?(?:get_?env|env|get|pop|setdefault|config|setting|getproperty|getstring)\Z")
_ELSE = re.compile(r"[ \t]*+(?:or|\|\||\?\?|\?:)[ \t]*+(?=[\"'])")
_HERE = re.compile(r"(?:\$\([ \t]*+cat[ \t]*+)?<<[-~]?[ \t]*+[\"']?([A-Za-z_][A-Za-z0-9_]*+)[\"']?[ \t]*+\r?\n")
#: Where a function or class begins: by indentation below its head, or by a brace.
_HEAD = re.compile(r"([ \t]*+)(?:async[ \t]++)?(?:def|class)[ \t]++[A-Za-z_]")
_BRACED = re.compile(r"(?:\bfunction\b|\bfunc\b|\bfn\b|\bclass\b|=>|\)[^;{}()]*+)[^;{}]*+\{[^\n]*+")
_NO_FUNCTION = re.compile(r"[ \t}]*+(?:if|for|while|switch|else|catch|do|try|with)\b")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
_HOLE = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*+)[^{}]*+\}")
_NOT_ASCII_WORD = re.compile(r"[^a-z0-9]++")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of the words of a target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "credential": 3, "credentials": 3, "apikey": 3, "token": 2, "auth": 2,
    "bearer": 2, "private": 2, "access": 1, "api": 1, "client": 1, "signing": 1, "encryption": 1, "key": 1,
}
#: Words of a name that speak against a secret.
HARMLESS = {
    "public", "example", "count", "length", "limit", "type", "name", "url", "path", "file", "id", "index", "max", "min", "ttl", "expiry", "policy", "rule", "rules", "format", "pattern", "regex", "hint",
    "label", "field", "column", "prompt", "message", "error", "help", "strength", "required", "endpoint",
}
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|change_?me|your[_-].*|example.*|todo|none|null|true|false|placeholder|<.*>|\$\{.*\}|%\(.*\)s)\Z")
#: Least score of a name-literal pair.
THRESHOLD = 4.0


def name_score(name: str) -> float:
    """The weights of a name's words, camel case and underscores parted. A name that ends in a harmless word names no secret."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    if words and words[-1] in HARMLESS:
        return 0
    return sum(SENSITIVE.get(w, 0) for w in [*words, *joined]) - 2 * sum(w in HARMLESS for w in words)


def literal_score(value: str) -> float:
    """0 to 3: length, kinds of characters and entropy; below 0 for placeholders and texts with blanks."""
    return _Value.literal(value, 0).score()


class _Value:
    """What a name holds: one literal, or several joined. Joins share their parts, so a value's cost does not grow with its length."""

    __slots__ = ("counts", "placeholder", "span", "parts", "told")

    def __init__(self, counts: Counter, placeholder: bool, span: tuple[int, int] | None, parts: tuple[_Value, ...]):
        self.counts, self.placeholder, self.span, self.parts, self.told = counts, placeholder, span, parts, False

    @classmethod
    def literal(cls, text: str, start: int) -> _Value:
        return cls(Counter(text), _PLACEHOLDER.match(text) is not None, (start, start + len(text)), ())

    @classmethod
    def joined(cls, parts: list[_Value]) -> _Value:
        if len(parts) == 1:
            return parts[0]
        counts = Counter()
        for p in parts:
            counts.update(p.counts)
        for c in counts:
            counts[c] = min(counts[c], 1 << 40)  # doubled again and again; the score has long been settled
        return cls(counts, all(p.placeholder for p in parts), None, tuple(parts))

    def score(self) -> float:
        n = sum(self.counts.values())
        if n < 6 or self.placeholder or any(c.isspace() for c in self.counts):
            return -9.0
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values())
        kinds = sum(any(test(c) for c in self.counts) for test in (_lower, _upper, _digit, _other))
        return min(1.0, n / 16) + min(1.0, entropy / 3.5) + min(1.0, (kinds - 1) / 2)

    def spans(self) -> list[tuple[int, int]]:
        """Those of its literals that were not told before."""
        out, waiting = [], [self]
        while waiting:
            v = waiting.pop()
            if not v.told:
                v.told = True
                waiting += v.parts
                if v.span:
                    out.append(v.span)
        return out


def _lower(c: str) -> bool:
    return "a" <= c <= "z"


def _upper(c: str) -> bool:
    return "A" <= c <= "Z"


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _other(c: str) -> bool:
    return not (_lower(c) or _upper(c) or _digit(c))


class _Scopes:
    """Which function or class each line lies in. A name is known in the scope where it is given a value and in those within it."""

    def __init__(self, text: str):
        self.lines, self.of = [], []  # where scopes change, and the path of scope numbers from there on
        path: list[tuple[int, int | None, int | None]] = []  # number, indentation of its head, braces open before its head
        at, n, depth = 0, 0, 0
        if not re.search(r"\b(?:def|class|function|func|fn)\b|=>|\)[^;{}()\n]*\{", text):
            return
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            if line.strip():
                indent = len(line) - len(line.lstrip(" \t"))
                while path and (path[-1][1] is not None and indent <= path[-1][1] or path[-1][2] is not None and depth <= path[-1][2]):
                    path.pop()
                if _HEAD.match(line) and "{" not in line:
                    n += 1
                    path.append((n, indent, None))
                elif "{" in line and _BRACED.search(line) and not _NO_FUNCTION.match(line):
                    n += 1
                    path.append((n, None, depth))
                depth += line.count("{") - line.count("}")
                now = tuple(p[0] for p in path)
                if now != (self.of[-1] if self.of else ()):
                    self.lines.append(at), self.of.append(now)
            at = end + 1

    def at(self, place: int) -> tuple[int, ...]:
        k = bisect_right(self.lines, place)
        return self.of[k - 1] if k else ()


class _Held:
    """The values of names, by scope."""

    def __init__(self):
        self.by: dict[tuple[int, ...], dict[str, _Value | None]] = {}
        self.scope: tuple[int, ...] = ()

    def get(self, name: str) -> _Value | None:
        for k in range(len(self.scope), -1, -1):
            own = self.by.get(self.scope[:k])
            if own is not None and name in own:
                return own[name]
        return None

    def put(self, name: str, value: _Value | None) -> None:
        self.by.setdefault(self.scope, {})[name] = value


class _Reader:
    """Reads a text's assignments in order. Names hold the values they were last given in their scope, as they were then."""

    def __init__(self, text: str):
        self.text, self.holds, self.scopes, self.no_end = text, _Held(), _Scopes(text), set()

    def _formatted(self, body: str, start: int) -> list[_Value]:
        """An f-string: its own stretches, and what the names in its holes hold."""
        parts, at = [], 0
        for m in _HOLE.finditer(body):
            if m.start() > at:
                parts.append(_Value.literal(body[at : m.start()], start + at))
            held = self.holds.get(m[1])
            parts += [held] if held else []
            at = m.end()
        return parts + ([_Value.literal(body[at:], start + at)] if at < len(body) or not parts else [])

    def _block(self, at: int, key_at: int) -> tuple[_Value | None, int]:
        """The lines that are indented deeper than the key's."""
        line_start = self.text.rfind("\n", 0, key_at) + 1
        indent = len(_GAP.match(self.text, line_start)[0])
        parts = []
        while at < len(self.text):
            m = _LINE.match(self.text, at)
            line = m[2].rstrip()
            if line and len(m[1]) <= indent:
                break
            if line and not line.startswith("-----"):  # the frame of an armoured key
                parts.append(_Value.literal(line, m.start(2)))
            at = m.end()
        return (_Value.joined(parts) if parts else None), at

    def value(self, at: int, key_at: int, colon: bool) -> tuple[_Value | None, int, list[str]]:
        """(value, its end, further names it is given to) of what stands at a place; no value where it is not made of literals."""
        text, names, parts = self.text, [], []
        at = _GAP.match(text, at).end()
        if colon and (m := _BLOCK.match(text, at)):
            return *self._block(m.end(), key_at), names
        if (m := _HERE.match(text, at)) and m[1] not in self.no_end:
            return *self._here(m), names
        bracket = text[at : at + 1] == "("
        gap, join = (_WIDE_GAP, _WIDE_JOIN) if bracket else (_GAP, _JOIN)
        at = gap.match(text, at + bracket).end()
        whole = True
        while m := _ATOM.match(text, at):
            kind = next((b for b in _BODIES if m[b] is not None), None)
            at = m.end()
            if kind and (m2 := _JOINED.match(text, at)):
                own, at = self._list(m2.end())  # the literal before it only parts them
                parts += own
            elif kind:
                parts += self._formatted(m[kind], m.start(kind)) if "f" in m["prefix"].lower() else [_Value.literal(m[kind], m.start(kind))]
            elif m["variable"]:
                held = self.holds.get(m["variable"])
                parts += [held] if held else []
                whole = whole and held is not None
            else:
                bare = m["bare"]
                after = _GAP.match(text, at).end()
                if text[after : after + 1] == "=" and text[after + 1 : after + 2] not in ("=", "~", ">") and not parts and bare[0] not in "0123456789":
                    names.append(bare)  # a = b = "x", a: kind = "x"
                    at = gap.match(text, after + 1).end()
                    continue
                if text[at : at + 1] == "(" and _LOOKS_UP.match(bare) and (m2 := _LOOKUP.match(text, at)):
                    at = m2.end()  # the value that stands in for what is looked up
                    continue
                if text[at : at + 1] in ("(", "["):  # a call or a place in something: no literal
                    return None, at, names
                if not parts and (m2 := _ELSE.match(text, at)) and not self.holds.get(bare):
                    at = m2.end()
                    continue
                held = [self.holds.get(x) for x in bare.split("+")]
                parts += held if all(held) else [_Value.literal(bare, m.start("bare"))]
                if not all(held) and not bracket and len(parts) == 1:
                    break
            step = join.match(text, at)
            if not step or not (kind or step[0].strip(" \t\r\n\\")):
                break
            if "%" in step[0] and parts and parts[-1].span:
                body = text[slice(*parts[-1].span)]
                if not _CODES.sub("", body).strip():
                    parts.pop()  # a format that only says where the values go
            at = step.end()
        return (_Value.joined(parts) if parts and whole else None), at, names

    def _list(self, at: int) -> tuple[list[_Value], int]:
        """Literals with commas between."""
        parts = []
        at = _WIDE_GAP.match(self.text, at).end()
        while (m := _ATOM.match(self.text, at)) and (kind := next((b for b in _BODIES if m[b] is not None), None)):
            parts.append(_Value.literal(m[kind], m.start(kind)))
            at = m.end()
            if not (step := _COMMA.match(self.text, at)):
                break
            at = step.end()
        return parts, at

    def _here(self, head: re.Match) -> tuple[_Value | None, int]:
        """The lines of a here-document; one without an end holds nothing."""
        m = re.compile(rf"^[ \t]*+{head[1]}[ \t]*+\r?$", re.MULTILINE).search(self.text, head.end())
        if not m:
            self.no_end.add(head[1])
            return None, head.end()
        parts, at = [], head.end()
        while at < m.start():
            line = _LINE.match(self.text, at, m.start())
            if (body := line[2].rstrip()) and not body.startswith("-----"):
                parts.append(_Value.literal(body, line.start(2)))
            at = line.end()
        return (_Value.joined(parts) if parts else None), m.end()

    def _row(self, names: list[str], at: int, key_at: int) -> tuple[list[tuple[str, _Value | None]], int]:
        """Names with the values of a row, one each; none where their numbers differ."""
        values, end = [], at
        while True:
            value, end, more = self.value(end, key_at, False)
            values.append(value)
            step = _COMMA.match(self.text, end)
            if more or not step or len(values) > len(names):
                break
            end = step.end()
        return list(zip(names, values if len(values) == len(names) else [None] * len(names), strict=True)), end

    def _above(self, opened: list, at: int, indent: int) -> str | None:
        """The key that a nested one lies under: the last one that had no value of its own and is still open."""
        text = self.text
        while opened:
            name, seen, own_indent, braced, depth = opened[-1]
            part = text[seen:at]
            if braced:
                for brace in re.finditer(r"[{}]", part):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        break
                open_ = depth > 0
            else:
                open_ = indent > own_indent and all(len(x) - len(x.lstrip(" \t")) > own_indent for x in part.split("\n")[1:-1] if x.strip())
            if open_:
                opened[-1] = (name, max(seen, text.rfind("\n", 0, at)) if not braced else at, own_indent, braced, depth)
                return name
            opened.pop()
        return None

    def secrets(self) -> list[tuple[int, int]]:
        text, found, at, opened = self.text, [], 0, []
        while m := _TARGET.search(text, at):
            self.holds.scope = self.scopes.at(m.start())
            carried = next((k for k in _CARRIED if m[k] is not None), None)
            if m["tag"]:
                given, at = [(m["tag"], _Value.literal(m["body"].strip(), m.start("body") + len(m["body"]) - len(m["body"].lstrip())))], m.start("body")
            elif carried:
                given, at = [(_CARRIED[carried], _Value.literal(m[carried], m.start(carried)))], m.end()
            elif m["row"]:
                given, end = self._row([x.strip() for x in m["row"].split(",")], m.end(), m.start())
                at = max(m.end(), end)
            else:
                target = m["attribute"] or m["key"] or m["name"] or m["setter"] or m["macro"] or m["option"] or m["pair"] or m["input"] or "password"
                keyed = m["colon"] is not None or m["key"] is not None
                value, end, names = self.value(m.end(), m.start(), keyed)
                if keyed and target.lower() in _NESTED and opened:
                    line = text.rfind("\n", 0, m.start()) + 1
                    target = self._above(opened, m.start(), len(_GAP.match(text, line)[0])) or target
                elif keyed and value is None and name_score(target) > 0:
                    gap = _GAP.match(text, m.end()).end()
                    if text[gap : gap + 1] == "{":
                        opened.append((target, gap + 1, 0, True, 1))
                    elif text[gap : gap + 1] in ("\n", "\r"):
                        line = text.rfind("\n", 0, m.start()) + 1
                        opened.append((target, gap, len(_GAP.match(text, line)[0]), False, 0))
                    del opened[:-8]
                if m["more"] and value and (old := self.holds.get(target)):
                    value = _Value.joined([old, value])
                # What stands in a literal may itself be an assignment; else reading goes on behind the value.
                inner = value is not None and value.span is not None and any(c in text[slice(*value.span)] for c in "=:<")
                at = max(m.end(), value.span[0] if inner else m.end() if value is None and not names else end)
                given = [(x, value) for x in ([target, *names] if target else names)]
            for name, value in given:
                self.holds.put(name, value)
                score = name_score(name)
                if value is not None and score > 0 and score + value.score() >= THRESHOLD:
                    found += value.spans()
        return sorted(set(found))


def lexed_secrets(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through names that hold them."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE) and not ("://" in low and "@" in low) and "identified" not in low:
        whole = _NOT_ASCII_WORD.sub("", low)  # neighbouring words of a name are also scored as one, whatever parts them
        if not any(w in whole for w in SENSITIVE):  # then no name can score
            return []
    return _Reader(text).secrets()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans by start, then kind as listed; each kind leftmost and without overlap, short matches dropped."""
    out = []
    low = text.lower()
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and not any(w in low for w in _ASSIGN_ROOTS):
            continue
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the lexed literals that no base span holds."""
    base = base_spans(text)
    starts, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    held = lambda s, e: (k := bisect_right(starts, s)) > 0 and reach[k - 1] >= e
    more = [("lexed", s, e) for s, e in lexed_secrets(text) if e > s and not held(s, e)]
    return base, sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, null texts as empty ones; code point spans. No shuffle, each row on its own.

    Texts of any length are read whole. Repeated rows are scanned one by one, no rows give no rows, other columns are left aside.
    """
    arrow = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, spans = all_spans(text or "")
                n = Counter(k for k, _, _ in spans)
                out.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n["lexed"]))
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)] if out else [[] for _ in arrow], schema=arrow)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(rows, SCHEMA)


def redact(docs: DataFrame, column: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret's span in the column replaced by mark, overlapping spans as one; nulls stay. Other columns are as they were."""

    @F.pandas_udf(T.StringType())
    def cover(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for _, start, end in all_spans(text)[1]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn(column, cover(F.col(column)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
