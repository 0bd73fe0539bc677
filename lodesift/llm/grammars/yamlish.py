"""YAML."""

from __future__ import annotations

import re

from lodesift.llm.grammars.engine import Bad

_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\n:#]|:(?!\s|$)|(?<!\s)#)*?)[ \t]*:(?=[ \t]|$)")
_PROPERTY = re.compile(r"(?:[&*][^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?=[ \t\n]|$)")
_BLOCK_SCALAR = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:#.*)?$")
_COMMENT = re.compile(r"[ \t]*(?:(?<![^\s])#.*)?$")
_BAD_START = "@`%"

_NOTHING = re.compile(r"[ \t]*(?:#.*)?$")
_MARKER = re.compile(r"(?:---|\.\.\.)(?:\s|$)")
_STOP = re.compile(r"\.\.\.(?:\s|$)")
_START = re.compile(r"---(?:\s|$)")
_DASH = re.compile(r"-(?:[ \t]|$)")
_QUERY = re.compile(r"\?(?:[ \t]|$)")
_EXPLICIT = re.compile(r"[?:](?:[ \t]|$)")
_REMARK = re.compile(r"[ \t]+#")
_DASH_BLANK = re.compile(r"-[ \t]")
_REMARKED = re.compile(r"[ \t]#")
_COLON = re.compile(r":(?:[ \t]|$)")


class _Yaml:
    """A line-oriented parser of block structure, with flow collections and quoted scalars read over lines."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.i = 0  # line
        self.n = len(self.lines)

    def skip(self) -> None:
        while self.i < self.n and _NOTHING.match(self.lines[self.i]):
            self.i += 1

    def marker(self) -> bool:
        return self.i < self.n and _MARKER.match(self.lines[self.i]) is not None

    def indent(self, line: str) -> int:
        return len(line) - len(line.lstrip(" "))

    def stream(self) -> None:
        explicit = False
        while True:
            self.skip()
            if self.i >= self.n:
                return
            line = self.lines[self.i]
            if line.startswith("%"):
                if explicit:
                    raise Bad("directive")
                self.i += 1
                continue
            if _STOP.match(line):
                self.i += 1
                continue
            if _START.match(line):
                rest = line[3:]
                explicit = True
                if _COMMENT.match(rest) or not rest.strip() or rest.strip().startswith("#"):
                    self.i += 1
                    self.skip()
                    if self.i >= self.n or self.marker():
                        continue
                else:
                    self.lines[self.i] = "   " + rest
                    if _KEY.match(rest.strip()) and rest.strip()[:1] not in "\"'":
                        raise Bad("mapping behind a document's start")
            self.node(-1)
            self.skip()
            if self.i < self.n and not self.marker():
                raise Bad("document end")

    def node(self, parent: int) -> None:
        """A block node that is indented by more than ``parent`` and starts on the line at hand."""
        self.skip()
        if self.i >= self.n or self.marker():
            return
        line = self.lines[self.i]
        col = self.indent(line)
        if col <= parent:
            return
        if line[col : col + 1] == "\t":
            raise Bad("tab")
        self.at(col, parent)

    def at(self, col: int, parent: int) -> None:
        """A node at column ``col`` of the line at hand."""
        text = self.lines[self.i][col:]
        if _DASH.match(text):
            self.sequence(col)
        elif _QUERY.match(text) or self.key(text) is not None:
            self.mapping(col)
        else:
            self.scalar(col, parent, False)

    def key(self, text: str) -> int | None:
        """The place behind the colon of an implicit key, or None."""
        p = 0
        while True:
            m = _PROPERTY.match(text, p)
            if not m or text[p] == "*" and _COMMENT.match(text, m.end()):
                break
            p = m.end()
            while p < len(text) and text[p] in " \t":
                p += 1
            if text[m.start()] == "*":
                return p + 1 if text[p : p + 1] == ":" else None
        if text[p : p + 1] in ("[", "{"):
            end = self.flow_end(text, p)
            if end is not None:
                m = re.compile(r"[ \t]*:(?=[ \t]|$)").match(text, end)
                return m.end() if m else None
            return None
        m = _KEY.match(text, p)
        return m.end() if m else None

    def flow_end(self, text: str, p: int) -> int | None:
        try:
            return _Flow(text, p).value()
        except Bad:
            return None

    def sequence(self, col: int) -> None:
        while self.i < self.n:
            self.skip()
            if self.i >= self.n or self.marker():
                return
            line = self.lines[self.i]
            c = self.indent(line)
            if c < col:
                return
            if c > col or line[c : c + 1] == "\t":
                raise Bad("indentation")
            if not _DASH.match(line[c:]):
                return
            rest = line[c + 1 :]
            if _COMMENT.match(rest):
                self.i += 1
                self.node(col)
            else:
                inner = c + 1 + len(rest) - len(rest.lstrip(" \t"))
                if "\t" in rest[: inner - c - 1]:
                    raise Bad("tab")
                self.lines[self.i] = " " * inner + line[inner:]
                self.value(inner, col)

    def value(self, col: int, parent: int) -> None:
        """A value that starts at ``col`` of the line at hand, maybe behind properties."""
        line = self.lines[self.i]
        p, some = col, False
        while True:
            m = _PROPERTY.match(line, p)
            if not m or line[p] == "*":
                break
            p = m.end()
            some = True
            while p < len(line) and line[p] in " \t":
                p += 1
        if some and _COMMENT.match(line[p:]) and (p >= len(line) or line[p] == "#"):
            self.i += 1
            self.node(parent)
            return
        self.at(col, parent)

    def mapping(self, col: int) -> None:
        while self.i < self.n:
            self.skip()
            if self.i >= self.n or self.marker():
                return
            line = self.lines[self.i]
            c = self.indent(line)
            if c < col:
                return
            if c > col or line[c : c + 1] == "\t":
                raise Bad("indentation")
            text = line[c:]
            if _EXPLICIT.match(text):
                end = 1
            else:
                if _DASH.match(text):
                    raise Bad("sequence in a mapping")
                k = self.key(text)
                if k is None:
                    raise Bad("key")
                end = k
            rest = text[end:]
            if not rest.strip() or _REMARK.match(rest):
                self.i += 1
                self.skip()
                if self.i < self.n and not self.marker():
                    nxt = self.lines[self.i]
                    ci = self.indent(nxt)
                    if nxt[ci : ci + 1] == "\t" and ci >= col:
                        raise Bad("tab")
                    if ci == col and _DASH.match(nxt[ci:]):
                        self.sequence(ci)
                    elif ci > col:
                        self.node(col)
                continue
            inner = c + end + len(rest) - len(rest.lstrip(" \t"))
            inline = line[inner:]
            p = self.after_properties(inline)
            if p < 0:  # only properties: the value is below
                self.i += 1
                self.skip()
                if self.i < self.n and not self.marker() and (self.indent(self.lines[self.i]) > col or (self.indent(self.lines[self.i]) == col and _DASH.match(self.lines[self.i][col:]))):
                    self.node(col - 1)
                continue
            if end != 1 and (self.key(inline[p:]) is not None and inline[p : p + 1] not in "[{") or _DASH_BLANK.match(inline[p:]):
                if end != 1:
                    raise Bad("mapping value")
                self.lines[self.i] = " " * inner + inline
                self.at(inner, col)
                continue
            self.scalar(inner + p, col, True)

    def after_properties(self, text: str) -> int:
        p = 0
        while True:
            m = _PROPERTY.match(text, p)
            if not m or text[p] == "*":
                return p
            p = m.end()
            while p < len(text) and text[p] in " \t":
                p += 1
            if p >= len(text) or text[p] == "#":
                return -1

    def scalar(self, col: int, parent: int, in_map: bool) -> None:
        """A scalar or flow collection at ``col``; its further lines are indented by more than ``parent``."""
        line = self.lines[self.i]
        text = line[col:]
        c = text[:1]
        if c == "*":
            m = _PROPERTY.match(text)
            if not m or not _COMMENT.match(text[m.end() :]):
                raise Bad("alias")
            self.i += 1
            return
        if c in "|>" and _BLOCK_SCALAR.match(text):
            self.i += 1
            while self.i < self.n and (not self.lines[self.i].strip() or self.indent(self.lines[self.i]) > parent):
                if parent < 0 and self.marker():
                    return
                self.i += 1
            return
        if c in "|>":
            raise Bad("block scalar")
        if c in "\"'[{":
            tail = "\n".join([text, *self.lines[self.i + 1 :]])
            flow = _Flow(tail, 0)
            end = flow.value()
            used = tail.count("\n", 0, end)
            if c in "[{":
                for k in range(1, used + 1):
                    x = self.lines[self.i + k]
                    if x.strip() and self.indent(x) <= parent and parent >= 0:
                        raise Bad("indentation")
            rest = tail[end : (tail.find("\n", end) if tail.find("\n", end) >= 0 else len(tail))]
            if rest.strip() and not _REMARK.match(rest):
                raise Bad("behind a value")
            self.i += used + 1
            return
        if c in _BAD_START or c in "]},":
            raise Bad("scalar")
        if c == "#":
            raise Bad("comment")
        # plain, maybe over several lines
        if self.mapped(text):
            raise Bad("mapping value")
        ended = _REMARKED.search(text) is not None
        self.i += 1
        while self.i < self.n:
            x = self.lines[self.i]
            if not x.strip():
                self.i += 1
                continue
            if self.marker():
                return
            ind = self.indent(x)
            if ind <= parent:
                return
            s = x.strip()
            if s.startswith("#"):
                ended = True
                self.i += 1
                continue
            if ended:
                raise Bad("behind a comment")
            if self.mapped(s):
                raise Bad("mapping value")
            ended = _REMARKED.search(s) is not None
            self.i += 1

    def mapped(self, text: str) -> bool:
        """Whether a plain text has a colon that would make it a key."""
        text = re.split(r"[ \t]#", text)[0]
        return _COLON.search(text) is not None


class _Flow:
    """Quoted scalars and flow collections."""

    def __init__(self, text: str, p: int):
        self.s, self.p, self.n = text, p, len(text)

    def blanks(self) -> None:
        while self.p < self.n:
            if self.s[self.p] in " \t\n":
                self.p += 1
            elif self.s[self.p] == "#" and (self.p == 0 or self.s[self.p - 1] in " \t\n"):
                end = self.s.find("\n", self.p)
                self.p = self.n if end < 0 else end
            else:
                return

    def value(self) -> int:
        s = self.s
        while True:
            m = _PROPERTY.match(s, self.p) if s[self.p : self.p + 1] in ("&", "!", "*") else None
            m = m or (re.compile(r"[&*][^\s,\[\]{}]+|![^\s,\[\]{}]*").match(s, self.p))
            if not m:
                break
            self.p = m.end()
            if s[m.start()] == "*":
                return self.p
            self.blanks()
        c = s[self.p : self.p + 1]
        if c == '"':
            m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(s, self.p)
            if not m or re.search(r"\\[^0abt\tnvfre \"/\\N_LPxuU\n]", re.sub(r"\\\\", "", m.group())):
                raise Bad("quote")
            if re.search(r"\n(?:---|\.\.\.)(?:\s|$)", m.group()):
                raise Bad("document marker")
            self.p = m.end()
        elif c == "'":
            m = re.compile(r"'(?:[^']|'')*'").match(s, self.p)
            if not m:
                raise Bad("quote")
            self.p = m.end()
        elif c in ("[", "{"):
            self.collection("]" if c == "[" else "}")
        else:
            m = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\n:#,\[\]{}]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*(?:\n[ \t]*(?:[^\s:#,\[\]{}]|:(?![\s,\[\]{}]))(?:[^\n:#,\[\]{}]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*)*").match(s, self.p)
            if not m:
                raise Bad("flow scalar")
            self.p = m.end()
        return self.p

    def collection(self, closing: str) -> None:
        self.p += 1
        while True:
            self.blanks()
            c = self.s[self.p : self.p + 1]
            if c == closing:
                self.p += 1
                return
            if c == "":
                raise Bad("flow collection")
            if c == "?" and self.s[self.p + 1 : self.p + 2] in (" ", "\n"):
                self.p += 1
                self.blanks()
            if c != ":":
                quoted = c in "\"'[{"
                self.value()
                self.blanks()
            else:
                quoted = False
            if self.s[self.p : self.p + 1] == ":" and (quoted or self.s[self.p + 1 : self.p + 2] in (" ", "\n", "\t", ",", "]", "}", "")):
                self.p += 1
                self.blanks()
                if self.s[self.p : self.p + 1] not in (",", closing):
                    self.value()
                    self.blanks()
            c = self.s[self.p : self.p + 1]
            if c == ",":
                self.p += 1
            elif c != closing:
                raise Bad("flow collection")


def yaml(text: str) -> None:
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        raise Bad("control character")
    _Yaml(text).stream()
