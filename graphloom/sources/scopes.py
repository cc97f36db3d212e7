"""Scopes of a script: which characters are code, which brackets belong together, which tags open elements.

One pass over tokens with a stack of modes (code, template text, inside a tag, between tags) tells strings, templates and
their holes, regular expressions, comments and the text of elements apart. It is no parser: expressions have no structure
beyond their brackets, and a variable statement declares its first name only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\+\+|--|\s+|.", re.S)
#: What neither opens, closes nor quotes anything: whole tokens, as those that do begin with another character.
PLAIN = re.compile(r"[^\"'`/<()\[\]{}]*")
BETWEEN = re.compile(r"[<{]")
CLOSING = re.compile(r"</\s*([\w$.:-]*)")
NOT_LINE = re.compile(r"[^\n]")
TEMPLATE_TEXT = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?(?=[\s/>])")
IN_TAG = re.compile(r"\s+|\"[^\"]*\"?|'[^']*'?|/\*.*?(?:\*/|\Z)|//[^\n]*|/>|.", re.S)
#: Words after which an expression starts.
OPERATORS = frozenset(("await", "case", "default", "delete", "do", "else", "in", "instanceof", "new", "of", "return", "throw", "typeof", "void", "yield"))
HEAD = re.compile(r"^[ \t]*(?=\S)((?:export\s+)?)((?:default\s+)?)(?:async\s+)?(?:function\b\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)(?![\w$]))", re.M)
VALUE = re.compile(r"\s*(?:async\b\s*)?(?:(function)\b|([A-Za-z_$][\w$]*)\s*=>|(?=[(<]))")


def _blank(text: str, ranges: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in ranges:
        parts += [text[at:a], NOT_LINE.sub(" ", text[a:b]) if "\n" in text[a:b] else " " * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


def _starts_value(before: str) -> bool:
    """Whether an operand can follow the token."""
    return not before or before in OPERATORS or not (before[-1].isalnum() or before[-1] in "_$)]}>\"'`+-" and before not in ("=>", "+", "-"))


def _last_token(text: str, start: int, end: int) -> str:
    """The last token of a plain stretch; none if it holds white space only."""
    last = ""
    for m in TOKEN.finditer(text, start, end):
        if not m[0].isspace():
            last = m[0]
    return last


def _self_closing(text: str, at: int) -> bool:
    depth = 0
    for m in IN_TAG.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth <= 0 and m[0] in ("/>", ">"):
            return m[0] == "/>"
    return False


@dataclass
class Scopes:
    """`code` is the text with comments blanked in place, `mask` with strings and texts blanked too."""

    code: str
    mask: str
    tags: list[tuple[int, str]]
    close: dict[int, int]
    tops: list[tuple[int, int]] = field(default_factory=list)

    def top(self, at: int) -> bool:
        """Whether no bracket is open at a position."""
        i = bisect_right(self.tops, (at, len(self.code))) - 1
        return i < 0 or not self.tops[i][0] < at <= self.tops[i][1]

    def walk(self, at: int, stops: str) -> int:
        """The first position from `at` on, brackets passed over, that holds one of `stops` (an equals sign is not that
        of an arrow), ends the statement, or ends the text."""
        mask, size = self.mask, len(self.mask)
        while at < size:
            c = mask[at]
            if c in "([{":
                if c in stops:
                    return at
                at = self.close.get(at, size)
            elif c in ";)]}" or (c == "\n" and re.match(r"[A-Za-z_$@]", mask[at + 1 : at + 2])):
                return at
            elif mask.startswith("=>", at):
                if ">" in stops:
                    return at
                at += 1
            elif c in stops and c != ">":
                return at
            at += 1
        return size

    def body(self, at: int) -> int | None:
        """The opening brace of a function's body, given the bracket that opens its parameters; None for a signature."""
        at = self.close.get(at, len(self.mask)) + 1
        while True:
            at = self.walk(at, "{")
            if self.mask[at : at + 1] != "{":
                return None
            last = at - 1
            while self.mask[last].isspace():
                last -= 1
            if self.mask[last] not in ":|&<,":
                return at
            at = self.close.get(at, len(self.mask)) + 1

    def declarations(self) -> list[tuple[int, int, str, bool, bool]]:
        """(start, end, name, exported, default) of the functions and variables that hold one, outside all brackets."""
        listed = {n for m in re.finditer(r"^export\s*\{([^}]*)\}(?!\s*from\b)", self.mask, re.M) for n in re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)", m[1])}
        default = {m[1] for m in re.finditer(r"^export\s+default\s+([A-Za-z_$][\w$]*)\s*(?:;|$)", self.mask, re.M)}
        out = []
        for m in HEAD.finditer(self.mask):
            start = m.start(1) if m[1] else m.start() + len(m[0]) - len(m[0].lstrip())
            if not self.top(start):
                continue
            if m[3]:
                brace = self.body(self.walk(m.end(), "("))
                if brace is not None:
                    out.append((start, self.close.get(brace, len(self.mask)) + 1, m[3], bool(m[1]) or m[3] in listed | default, bool(m[2]) or m[3] in default))
                continue
            at = self.walk(m.end(), "=")
            if self.mask[at : at + 1] != "=":
                continue
            value = VALUE.match(self.mask, at + 1)
            if not value:
                continue
            if not (value[1] or value[2]):
                after = self.close.get(self.walk(value.end(), "("), len(self.mask)) + 1
                if not re.match(r"\s*(?::|=>)", self.mask[after : after + 200]) or not self.mask.startswith("=>", self.walk(after, ">")):
                    continue
            end = self.walk(at + 1, "")
            out.append((start, end, m[4], bool(m[1]), False))
        return out


def scopes(text: str) -> Scopes:
    comments: list[tuple[int, int]] = []
    quiet: list[tuple[int, int]] = []
    tags: list[tuple[int, str]] = []
    close: dict[int, int] = {}
    tops: list[tuple[int, int]] = []
    opens: list[int] = []
    modes: list[tuple[str, int]] = [("code", 0)]  # a mode, and how many brackets were open before it
    closing = set(CLOSING.findall(text))
    at, size, before = 0, len(text), ""

    def hole(position: int) -> None:
        modes.append(("code", len(opens)))
        opens.append(position)

    while at < size:
        mode, outer = modes[-1]
        if mode == "template":
            m = TEMPLATE_TEXT.match(text, at)
            quiet.append((at, m.start(1)))
            at = m.end()
            if m[1] == "${":
                hole(at - 1)
                before = "{"
            else:
                modes.pop()
                before = "`"
        elif mode == "between":
            stop = BETWEEN.search(text, at)
            quiet.append((at, stop.start() if stop else size))
            if not stop:
                break
            at, m = stop.start(), TAG.match(text, stop.start())
            if stop[0] == "{":
                hole(at)
                at, before = at + 1, "{"
            elif text.startswith("</", at):
                at = text.find(">", at) + 1 or size
                modes.pop()
                before = ")"
            elif m:
                tags.append((at, m[1] or ""))
                modes.append(("tag", len(opens)))
                at = m.end()
            else:
                at += 1
        elif mode == "tag":
            m = IN_TAG.match(text, at)
            if m[0] == "/>":
                modes.pop()
                before = ")"
            elif m[0] == ">":
                modes[-1] = ("between", outer)
            elif m[0] == "{":
                hole(at)
                before = "{"
            elif m[0][0] in "\"'":
                quiet.append((at + 1, m.end() - 1))
            elif m[0][:2] in ("//", "/*"):
                quiet.append(m.span())
                comments.append(m.span())
            at = m.end()
        else:
            start, at = at, PLAIN.match(text, at).end()
            if at == size:
                break
            t = text[at]
            if t in "([{":
                opens.append(at)
                at, before = at + 1, t
            elif t in ")]}":
                if opens:
                    first = opens.pop()
                    close[first] = at
                    if not opens:
                        tops.append((first, at))
                    if len(modes) > 1 and len(opens) == outer:
                        modes.pop()
                at, before = at + 1, t
            elif t in "\"'":
                m = TOKEN.match(text, at)
                quiet.append((at + 1, max(at + 1, m.end() - 1)))
                at, before = m.end(), m[0]
            elif t == "`":
                modes.append(("template", len(opens)))
                at, before = at + 1, t
            else:
                before = _last_token(text, start, at) or before
                if text.startswith(("//", "/*"), at):
                    m = TOKEN.match(text, at)
                    quiet.append(m.span())
                    comments.append(m.span())
                    at = m.end()
                elif t == "/" and _starts_value(before) and (regex := REGEX.match(text, at)):
                    quiet.append((at + 1, regex.end() - 1))
                    at, before = regex.end(), "`"
                elif t == "<" and _starts_value(before) and (tag := TAG.match(text, at)) and ((tag[1] or "") in closing or _self_closing(text, tag.end())):
                    tags.append((at, tag[1] or ""))
                    modes.append(("tag", len(opens)))
                    at, before = tag.end(), "("
                else:
                    at, before = at + 1, t
    if opens:
        tops.append((opens[0], size))
    return Scopes(_blank(text, comments), _blank(text, quiet), tags, close, tops)
