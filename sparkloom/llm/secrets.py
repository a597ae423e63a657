"""Secret scans by assignment-aware lexing.

Base rules find three kinds of literal by pattern. The lexer adds ``literal``
spans. It reads source and configuration syntax into tokens, strings with their
escapes, names and what may stand between a name and its value, and pairs of a
name and an expression:

* ``name = value``, ``name := value``, ``name => value``, ``"name": value``,
  ``env["name"] = value``, ``--name value``
* declarations with a type: ``name: type = value``, ``name string = value``,
  ``char name[] = value``
* ``<name>value</name>``, ``key="name" value="value"``, ``name: |`` with an
  indented block

An expression is a bare value, or strings and names that stand side by side or
are joined by ``+`` or ``.``; strings may be triple-quoted or hold ``{name}``.
Names are followed to the expressions that they stand for, whether those come
before or after. Strings are read for pairs of their own. A literal is scored by
the sensitive words of its target's name and by its own randomness. Comments are
read like code: a secret in one is still a secret.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_HINT = ("pass", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Weight of words in a target's name, beside "key" and "id" that only count with others.
_SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "private": 2, "signing": 2, "access": 1, "key": 1, "salt": 1}
_PUBLIC = {"public", "example", "test", "length", "count", "size", "name", "type", "url", "path", "file"}
#: Without one of these no name has a score of 2.
_STEMS = ("pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth", "bearer", "private", "signing", "access", "salt")
#: A pair counts from this product of its name's weight and its literal's bits on.
LEAST = 80.0
#: Values that an expression may take, in characters; longer ones count as unknown.
LONGEST = 1 << 16

_PREFIX = r"(?P<prefix>(?<![A-Za-z0-9_])[fFrRbBuU]{0,2})"
_STRING = _PREFIX + (
    r"""(?:\"\"\"(?P<t>[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+)\"\"\"|'''(?P<u>[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+)'''"""
    r"""|"(?P<d>[^"\\\r\n]*+(?:\\[^\r\n][^"\\\r\n]*+)*+)"|'(?P<s>[^'\\\r\n]*+(?:\\[^\r\n][^'\\\r\n]*+)*+)')"""
)
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:[.\-][A-Za-z0-9_$]++)*+"
_TOKEN = re.compile(rf"{_STRING}|(?P<name>(?:(?<!\S)--?)?(?<![A-Za-z0-9_]){_NAME})", re.DOTALL)
_ONE_STRING = re.compile(_STRING, re.DOTALL)
_ONE_NAME = re.compile(_NAME)
#: A type of a declaration: str, &'static str, Optional[str], std::string, string | null.
_TYPE = r"""[&*]{0,2}(?:'[a-z_]+[ \t]+)?(?:(?:mut|const)[ \t]+)?[A-Za-z_][A-Za-z0-9_.:]*+(?:[<\[][^=;"'\r\n]{0,200}[>\]])?[?!*&]?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*+)*+"""
_TYPED = re.compile(rf"""[ \t]*:[ \t]*(?P<type>{_TYPE})(?:[ \t]+=[ \t]+|[ \t]*=[ \t]*(?=["']))""")
_GO_TYPE = re.compile(r"""[ \t]+(?:\*?string|\[\]byte)[ \t]*=[ \t]*(?=["'])""")
_IS = re.compile(r"""(?:\[[0-9]*\]|\])?[ \t]*(?::=|=>|=(?![=~>])|:(?![:/=]))[ \t]*""")
_FLAG = re.compile(r"[ \t]+(?=[^\s\-])")
_BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*\r?\n")
_BARE = re.compile(r"""[^\s"',;(){}\[\]<>]+""")
_JOIN = re.compile(r"[ \t]*(?:(?P<plus>[+.])[ \t]*(?:\\?\r?\n[ \t]*)?|\\\r?\n[ \t]*|(?=[\"']))")
_VALUE_ATTRIBUTE = re.compile(r"\s+value[ \t]*=[ \t]*")
_ELEMENT = re.compile(r">([^<>]+)</")
_HOLE = re.compile(rf"\{{[ \t]*({_NAME})[ \t]*\}}")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))", re.DOTALL)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: kind ("literal", "format" or "name"), text, start, end
Part = tuple[str, str, int, int]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


def _sensitive(low: str) -> bool:
    return any(s in low for s in _STEMS)


def name_score(name: str) -> int:
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = "".join(words)
    score = sum(_SENSITIVE.get(w, 0) for w in set(words))
    if "apikey" in joined and "api" in words:
        score += 2
    return 0 if score < 2 or _PUBLIC & set(words) else score


def literal_bits(value: str, phrase: bool = False) -> float:
    """Bits of a literal, more for mixed character classes and fewer for one
    word; nothing for short ones, or for words unless a phrase is asked for."""
    if phrase and len(set(value.split())) >= 4:
        return 12.0 * len(set(value.split()))
    if len(value) < 8 or any(c.isspace() for c in value.strip()):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    letters = re.fullmatch(r"[A-Za-z][a-z]*|[A-Z]+|[a-z]+(?:[_\-.][a-z]+)+", value)
    return _entropy(value) * len(value) * (0.3 if letters else 0.5 + 0.25 * classes)


def unescaped(literal: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else _CONTROL.get(m[3], m[3]), literal)


def _string_part(m: re.Match) -> Part:
    group = next(g for g in "tuds" if m[g] is not None)
    prefix = m["prefix"].lower()
    value = m[group] if "r" in prefix else unescaped(m[group])
    return ("format" if "f" in prefix else "literal", value, m.start(group), m.end(group))


def _expression(text: str, at: int) -> list[Part]:
    """The parts of the expression that starts at a position."""
    parts: list[Part] = []
    joined = True
    while True:
        if m := _ONE_STRING.match(text, at):
            parts.append(_string_part(m))
            at = m.end()
        elif joined and parts and (m := _ONE_NAME.match(text, at)):
            parts.append(("name", m[0], m.start(), m.end()))
            at = m.end()
        elif not parts and (m := _BARE.match(text, at)):
            bare, end = m[0], m.end()
            name = _ONE_NAME.fullmatch(bare)
            if name and end < len(text) and text[end] in "([":
                return []  # a call or an index, no literal
            more = _JOIN.match(text, end) if name else None
            parts.append(("name" if name else "literal", bare, at, end))
            if not (more and more["plus"] and more.end() > end):
                return parts
            at = end
        else:
            return parts
        m = _JOIN.match(text, at)
        if not m or not (m["plus"] or text[m.end() : m.end() + 1] in ('"', "'")):
            return parts
        joined, at = bool(m["plus"]), m.end()


def _indented_block(text: str, name_at: int, at: int) -> list[Part]:
    """Lines from a position on that stand deeper than the line of the name."""
    line = text.rfind("\n", 0, name_at) + 1
    depth = len(text[line:name_at]) - len(text[line:name_at].lstrip(" \t-"))
    first, end = None, at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        row = text[at:stop]
        if row.strip():
            indent = len(row) - len(row.lstrip(" \t"))
            if indent <= depth:
                break
            first = at + indent if first is None else first
            end = at + len(row.rstrip())
        at = stop + 1
    return [("literal", text[first:end], first, end)] if first is not None else []


def lex_pairs(text: str) -> list[tuple[str, list[Part]]]:
    """(name, parts of its expression) in order; strings are read for their own pairs too."""
    out: list[tuple[str, list[Part]]] = []
    work = [(0, text)]
    while work:
        base, body = work.pop()
        for m in _TOKEN.finditer(body):
            pairs: list[tuple[str, list[Part]]] = []
            name, end = m["name"], m.end()
            if name is None:
                kind, name, start, stop = _string_part(m)
                if stop - start > 8 and _sensitive(body[start:stop].lower()):
                    work.append((base + start, body[start:stop]))
                if len(name) > 200 or not _ONE_NAME.fullmatch(name):
                    continue
            if typed := _TYPED.match(body, end):
                pairs.append((name, _expression(body, typed.end())))
                if any("0" <= c <= "9" for c in typed["type"]):  # rather a bare value
                    pairs.append((name, [("literal", typed["type"], typed.start("type"), typed.end("type"))]))
            elif go := _GO_TYPE.match(body, end):
                pairs.append((name, _expression(body, go.end())))
            elif sep := _IS.match(body, end):
                if block := _BLOCK.match(body, sep.end()):
                    pairs.append((name, _indented_block(body, m.start(), block.end())))
                else:
                    pairs.append((name, _expression(body, sep.end())))
                    if name.lower() in ("key", "name", "id") and (given := pairs[-1][1]) and given[0][0] == "literal" and (value := _VALUE_ATTRIBUTE.match(body, given[-1][3] + 1)):
                        pairs.append((given[0][1], _expression(body, value.end())))
            elif m["name"] and name.startswith("-") and (flag := _FLAG.match(body, end)):
                pairs.append((name, _expression(body, flag.end())))
            elif m["name"] and body[m.start() - 1 : m.start()] == "<" and (element := _ELEMENT.match(body, end)):
                pairs.append((name, [("literal", element[1].strip(), element.start(1) + len(element[1]) - len(element[1].lstrip()), element.start(1) + len(element[1].rstrip()))]))
            out += [(n, [(kind, value, base + a, base + b) for kind, value, a, b in parts]) for n, parts in pairs if parts]
    return sorted(out, key=lambda p: p[1][0][2])


class Constants:
    """What the pairs' expressions stand for. A name stands for its last
    definition before the use, else for its first after it; one that leads back
    to itself is unknown."""

    def __init__(self, pairs: list[tuple[str, list[Part]]]):
        self.pairs, self.defined = pairs, {}
        for i, (name, _) in enumerate(pairs):
            self.defined.setdefault(name, []).append(i)
        self.done: dict[int, tuple[str, list[tuple[int, int]]] | None] = {}

    def _target(self, name: str, user: int) -> int | None:
        at = [i for i in self.defined.get(name, ()) if i != user]
        return max((i for i in at if i < user), default=min(at, default=None)) if at else None

    def _uses(self, i: int) -> list[int]:
        named = [t for kind, t, _, _ in self.pairs[i][1] if kind == "name"] + [n for kind, t, _, _ in self.pairs[i][1] if kind == "format" for n in _HOLE.findall(t)]
        return [d for n in named if (d := self._target(n, i)) is not None]

    def value(self, i: int) -> tuple[str, list[tuple[int, int]]] | None:
        """(text, spans of the literals that it comes from), None if unknown."""
        stack, open_ = [i], set()
        while stack:
            now = stack[-1]
            wanted = [d for d in self._uses(now) if d not in self.done and d not in open_] if now not in self.done else []
            if wanted:
                open_.add(now)
                stack += wanted
                continue
            if now not in self.done:
                self.done[now] = self._join(now)
            stack.pop()
            open_.discard(now)
        return self.done[i]

    def _known(self, name: str, user: int):
        target = self._target(name, user)
        return self.done.get(target) if target is not None else None

    def _join(self, i: int):
        text, spans, own = "", [], []
        parts = self.pairs[i][1]
        for kind, value, start, end in parts:
            if kind == "name":
                if found := self._known(value, i):
                    text, spans = text + found[0], spans + found[1]
                elif len(parts) == 1:
                    text, own = value, [(start, end)]  # a bare value
            else:
                if kind == "format":
                    for hole in _HOLE.findall(value):
                        if found := self._known(hole, i):
                            value = re.sub(rf"\{{[ \t]*{re.escape(hole)}[ \t]*\}}", lambda m, t=found[0]: t, value)
                            spans = spans + found[1]
                text, own = text + value, [*own, (start, end)]
            if len(text) > LONGEST:
                return None
        if own and len(own) == len(parts):
            own = [(own[0][0], own[-1][1])]
        return text, own + spans


def assigned_secrets(text: str, least: float = LEAST) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name gets, directly or through constants."""
    low = text.lower()
    if not (_sensitive(low) and any(c in text for c in "=:>-")):
        return []
    pairs = lex_pairs(text)
    known, found = Constants(pairs), set()
    for i, (name, _) in enumerate(pairs):
        if (score := name_score(name)) and (made := known.value(i)) and score * literal_bits(made[0], "phrase" in name.lower()) >= least:
            found |= {s for s in made[1] if s[1] > s[0]}
    return sorted(found)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINT):
        spans += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    spans += [(a, b, 3) for a, b in assigned_secrets(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by mask."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN = "struct<start:bigint,end:bigint,kind:string>"
_FOUND = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))), ("masked", pa.string())])


def _scanner(mask: str | None):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            rows = []
            for t in texts.to_pylist():
                spans = scan(t) if t else []
                rows.append({"spans": [{"start": a, "end": b, "kind": k} for a, b, k in spans], "masked": masked(t, spans, mask) if spans and mask is not None else None})
            yield pa.array(rows, _FOUND)

    return F.arrow_udf(run, f"struct<spans:array<{_SPAN}>,masked:string>").asNondeterministic()


def find_secrets(docs: DataFrame, *, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """Adds secret_spans array<struct<start,end,kind>> to every row of docs, and
    with a mask replaces each span, or run of overlapping spans, in the text.

    Kinds: assign, access, hex (patterns, leftmost and non-overlapping by kind)
    and literal (the lexer's). Spans of different kinds may overlap. Whole texts
    of any length are read; a null or empty text has no spans. Repeated rows
    stay. A column of docs named secret_spans is replaced, no other name matters.
    An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("secret_spans")
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    found = base.select(*[quoted(c) for c in base.columns], _scanner(mask)(quoted(text_col).cast("string")).alias("secret_spans"))
    text = quoted(text_col)
    kept = [F.coalesce(F.col("secret_spans.masked"), text).alias(c) if c == text_col and mask is not None else quoted(c) for c in base.columns]
    return found.select(*kept, F.col("secret_spans.spans").alias("secret_spans"))


def redacted(text: str | Column, mask: str = "[secret]") -> Column:
    """The text with its secrets replaced by mask; as it is where it has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_scanner(mask)(text.cast("string"))["masked"], text)
