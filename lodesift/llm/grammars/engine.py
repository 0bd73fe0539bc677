"""Parsing by bracket reduction.

The lexer turns a text into one character per token. Bracket pairs (in some languages also pairs of
words such as ``do`` and ``end``) are reduced from the inside out: the flat content of a pair is parsed as each
thing such a pair can be (a block, an object, a parameter list, ...), and the pair becomes one
character that stands for the set of what it can be. What remains at the top must be a program. Equal
contents are parsed once, so repeated code costs little.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

_FIRST_TOKEN, _FIRST_GROUP, _MASKS = 0x100, 0xF0000, 4096
#: Behind the last token of a content.
END = "\0"
#: Tokens from which a text that may still be a program is lexed at once, where its language allows.
AT_ONCE = 2 * 24
#: Tokens after which a lexer first asks whether the text can still become a program; then after twice as many, and so on.
PROBE = 24


class Bad(Exception):
    """The text is not in the language."""


class Grammar:
    """Token characters, kinds of pairs and what they can be."""

    def __init__(self, tokens: Sequence[str], groups: dict[str, Sequence[str]], pairs: dict[str, str]):
        self.char = {t: chr(_FIRST_TOKEN + i) for i, t in enumerate(dict.fromkeys(tokens))}
        self.token = {c: t for t, c in self.char.items()}
        self.groups = {k: list(v) for k, v in groups.items()}
        self.base = {k: _FIRST_GROUP + i * _MASKS for i, k in enumerate(groups)}
        self.can: dict[str, frozenset[str]] = {}
        for k, names in self.groups.items():
            for i, n in enumerate(names):
                self.can[n] = frozenset(chr(self.base[k] + m) for m in range(1 << len(names)) if m >> i & 1) | self.can.get(n, frozenset())
        self.tests: dict[str, Callable[[str], None]] = {}
        self.seen: dict[tuple[str, str], str] = {}
        self.pairs: dict[str, list[tuple[str, str]]] = {}
        chars = ""
        for both, kind in pairs.items():
            a, b = both.split()
            self.pairs.setdefault(self.char[a], []).append((self.char[b], kind))
            chars += self.char[a] + self.char[b]
        self.brackets = re.compile(f"[{chars}]")

    def set(self, tokens: str) -> frozenset[str]:
        """The characters of the tokens named in a text."""
        return frozenset(self.char[t] for t in tokens.split())

    def fits(self, name: str, content: str) -> bool:
        try:
            self.tests[name](content + END)
        except Bad:
            return False
        return True

    def reduce(self, kind: str, content: str) -> str:
        """The character of a pair with this content; ``Bad`` if it can be nothing."""
        key = (kind, content)
        c = self.seen.get(key)
        if c is None:
            mask = sum(1 << i for i, name in enumerate(self.groups[kind]) if self.fits(name, content))
            if len(self.seen) > 200_000:
                self.seen.clear()
            c = self.seen[key] = chr(self.base[kind] + mask) if mask else ""
        if not c:
            raise Bad(kind)
        return c

    def run(self, tokens: str, top: str) -> None:
        """Reduces all pairs and parses the rest as ``top``."""
        Reduction(self, top).finish(tokens)

    def may_be(self, names: Iterable[str], start: str) -> bool:
        """Whether a content that begins with ``start`` may be one of ``names``."""
        for name in names:
            try:
                self.tests[name](start)  # without an end: whoever looks beyond the last token fails otherwise
            except IndexError:
                return True
            except Bad:
                continue
            return True
        return False


class Reduction:
    """The reduction of a text whose tokens come bit by bit."""

    def __init__(self, g: Grammar, top: str):
        self.g, self.top = g, top
        self.stack: list[tuple[list[tuple[str, str]], list[str]]] = []
        self.parts: list[str] = []

    def feed(self, tokens: str) -> None:
        """Reduces the pairs that ``tokens`` closes; ``Bad`` if one can be nothing."""
        g, stack, parts, at = self.g, self.stack, self.parts, 0
        opens, seen = g.pairs.get, g.seen.get
        for m in g.brackets.finditer(tokens):
            i = m.start()
            c = tokens[i]
            if i > at:
                parts.append(tokens[at:i])
            at = i + 1
            opening = opens(c)
            if opening is not None:
                stack.append((opening, parts))
                parts = []
            else:
                if not stack:
                    raise Bad("bracket")
                closings, outer = stack.pop()
                for closing, kind in closings:
                    if closing == c:
                        break
                else:
                    raise Bad("bracket")
                content = parts[0] if len(parts) == 1 else "".join(parts)
                outer.append(seen((kind, content)) or g.reduce(kind, content))
                parts = outer
        parts.append(tokens[at:])
        self.parts = parts

    def probe(self, tokens: str) -> None:
        """Feeds ``tokens``; ``Bad`` if no text that begins with what was fed can be parsed.

        A pair that can be nothing is final, and so is a fault that the parser finds without having looked beyond the last token.
        """
        self.feed(tokens)
        contents = ["".join(outer) for _, outer in self.stack] + ["".join(self.parts)]
        if not self.g.may_be((self.top,), contents[0]):
            raise Bad(self.top)
        for (closings, _), content in zip(self.stack, contents[1:], strict=True):
            if not any(self.g.may_be(self.g.groups[kind], content) for _, kind in closings):
                raise Bad("pair")

    def finish(self, tokens: str) -> None:
        """Feeds the last tokens and parses the rest."""
        self.feed(tokens)
        if self.stack:
            raise Bad("open bracket")
        g, rest = self.g, "".join(self.parts)
        ok = g.seen.get(("", self.top + rest))
        if ok is None:
            ok = g.seen["", self.top + rest] = "y" if g.fits(self.top, rest) else ""
        if not ok:
            raise Bad(self.top)


def mark_angles(out: list[str], lt: str, gt: str, marks: tuple[str, str], inside: frozenset[str], after: frozenset[str], nests: dict[str, str]) -> None:
    """Replaces ``<`` and ``>`` that enclose type arguments by ``marks``, in place.

    They do if between them are only tokens of ``inside``, with brackets (``nests``) in pairs, and
    the token behind is one of ``after`` or the text ends.
    """
    i, n = 0, len(out)
    closing = set(nests.values())
    while i < n:
        if out[i] != lt:
            i += 1
            continue
        open_, stack, pairs, j = [], [], [], i + 1
        while j < n:
            c = out[j]
            if c == lt:
                open_.append(j)
                stack.append(gt)
            elif c == gt:
                if stack:
                    if stack.pop() != gt:
                        break
                    pairs.append((open_.pop(), j))
                else:
                    pairs.append((i, j))
                    if j + 1 == n or out[j + 1] in after:
                        for a, b in pairs:
                            out[a], out[b] = marks
                    break
            elif c in nests:
                stack.append(nests[c])
            elif c in closing:
                if not stack or stack.pop() != c:
                    break
            elif c not in inside:
                break
            j += 1
        i += 1


def token_pattern(parts: dict[str, str], flags: int = 0, skip: str = "") -> re.Pattern[str]:
    """A lexer's pattern of named alternatives, behind what may be skipped; with ``skip``, ``end`` is the end of the text."""
    named = "|".join(f"(?P<{k}>{v})" for k, v in parts.items())
    return re.compile(f"{skip}(?:{named}|(?P<end>\\Z))" if skip else named, flags)


def operators(ops: Iterable[str]) -> str:
    """A pattern of operators, the longest first."""
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))


class Tokens(dict):
    """The character of every token text of a language, found once per text; ``of`` names a token by its text."""

    def __init__(self, char: dict[str, str], of: Callable[[str], str], most: int = 200_000):
        super().__init__()
        self.char, self.of, self.most = char, of, most

    def __missing__(self, text: str) -> str:
        if len(self) > self.most:
            self.clear()
        name = self.of(text)
        c = self[text] = self.char[name] if name in self.char else name
        return c

    def read(self, texts: Iterable[str]) -> str:
        """The characters of the tokens, one behind the other."""
        return "".join(map(self.__getitem__, texts))


def flat_pattern(parts: dict[str, str], flags: int = 0, skip: str = "") -> re.Pattern[str]:
    """A lexer's pattern whose only group is the token, for lexing a whole text at once; whatever isn't a token comes as a character of its own, and the end as nothing."""
    return re.compile(f"{skip}({'|'.join(parts.values())}|\\Z|.)", flags | re.S)


class Flat:
    """Helpers of a parser of flat contents: every method takes a place and gives the place behind."""

    def __init__(self, g: Grammar):
        self.g = g
        self.c = g.char
        self.can = g.can

    def need(self, s: str, p: int, token: str) -> int:
        if s[p] != self.c[token]:
            raise Bad(token)
        return p + 1

    def group(self, s: str, p: int, name: str) -> int:
        if s[p] not in self.can[name]:
            raise Bad(name)
        return p + 1

    def whole(self, parse: Callable[[str, int], int], drop: str = "", empty: bool = False) -> Callable[[str], None]:
        """A test that ``parse`` reads all of a content; ``drop`` names tokens that don't count in it."""
        gone = {ord(self.c[d]): None for d in drop.split()}

        def test(s: str) -> None:
            if gone:
                s = s.translate(gone)
            if empty and s == END:
                return
            if s[parse(s, 0)] != END:
                raise Bad("rest")

        return test

    def listed(self, item: Callable[[str, int], int], comma: str = ",", trailing: bool = True, empty: bool = True) -> Callable[[str, int], int]:
        """Items with commas between them."""
        sep = self.c[comma]

        def parse(s: str, p: int) -> int:
            if s[p] == END and empty:
                return p
            p = item(s, p)
            while s[p] == sep:
                p += 1
                if s[p] == END and trailing:
                    return p
                p = item(s, p)
            return p

        return parse

    def run_of(self, item: Callable[[str, int], int]) -> Callable[[str, int], int]:
        """Items one after the other, up to the end."""

        def parse(s: str, p: int) -> int:
            while s[p] != END:
                q = item(s, p)
                if q == p:
                    raise Bad("item")
                p = q
            return p

        return parse

    def attempt(self, parse: Callable[[str, int], int], s: str, p: int) -> int:
        """The place behind, or -1."""
        try:
            return parse(s, p)
        except Bad:
            return -1
