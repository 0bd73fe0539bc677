"""C."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import lru_cache

from lodesift.llm.grammars.engine import Bad, END, Flat, Grammar, PROBE, Reduction, operators, token_pattern

_TYPES = "void char short int long float double signed unsigned _Bool _Complex __int128".split()
_QUALIFIERS = "const volatile restrict static extern register auto typedef inline _Noreturn _Thread_local _Atomic __inline __inline__ __restrict __extension__ __const __volatile__".split()
_WORDS = [*_TYPES, *_QUALIFIERS, *"struct union enum if else for while do switch case default break continue return goto sizeof _Alignof _Alignas _Static_assert _Generic __attribute__ __asm__ asm typeof __typeof__ __declspec".split()]
_HARD = frozenset(_WORDS)
_OPS = "{ } ( ) [ ] ; , . ... -> ++ -- & * + - ~ ! / % << >> < > <= >= == != ^ | && || ? : = += -= *= /= %= <<= >>= &= ^= |=".split()
_LEXER = token_pattern(
    {
        "word": r"[^\W\d][\w$]*+|\$[\w$]*+",
        "nl": r"\n",
        "num": r"0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?[uUlLfF]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLfF]*(?!\w)",
        "str": r"(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"",
        "chr": r"[uUL]?'(?:[^'\\\n]|\\.)+'",
        "pp": r"\#(?:[^\\\n/\"']|\\.|/(?![*/])|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|['\"])*",
        "op": operators(_OPS),
    },
    re.S,
    r"(?:[ \t\r\f\v]|\\\n|//(?:[^\\\n]|\\.)*|/\*.*?\*/)*+",
)
_DIRECTIVE = re.compile(r"#[ \t]*(?:(?:include|import|include_next)\b[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*.*)|define[ \t]+[A-Za-z_]\w*.*|undef[ \t]+[A-Za-z_]\w*|(?:ifdef|ifndef)[ \t]+[A-Za-z_]\w*.*|(?:if|elif)\b.+|else\b.*|endif\b.*|pragma\b.*|error\b.*|warning\b.*|line\b.+|)\s*$", re.S)


class _C(Flat):
    def __init__(self) -> None:
        g = Grammar(
            ["ID", "LIT", "STR", *_WORDS, *_OPS],
            {
                "brace": ["block", "init", "fields", "enumerators"],
                "paren": ["expr", "args", "params", "forhead", "typename", "declarator", "any"],
                "square": ["size"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square"},
        )
        super().__init__(g)
        self.types = g.set(" ".join(_TYPES))
        self.qualifiers = g.set(" ".join(_QUALIFIERS))
        self.prefix = g.set("+ - ! ~ & * ++ --")
        self.binary = g.set("+ - * / % << >> < > <= >= == != & ^ | && || = += -= *= /= %= <<= >>= &= ^= |=")
        t = g.tests
        t["block"] = self.whole(self.run_of(self.statement))
        t["init"] = self.whole(self.listed(self.initializer, empty=True))
        t["fields"] = self.whole(self.run_of(self.field))
        t["enumerators"] = self.whole(self.listed(self.enumerator, empty=False))
        t["expr"] = self.whole(self.comma)
        t["args"] = self.whole(self.listed(self.argument, trailing=False))
        t["params"] = self.whole(self.listed(self.param, trailing=False))
        t["forhead"] = self.whole(self.for_head)
        t["typename"] = self.whole(self.type_name)
        t["declarator"] = self.whole(lambda s, p: self.declarator(s, p, True))
        t["any"] = lambda s: None
        t["size"] = self.whole(self.size, empty=True)
        t["program"] = self.whole(self.run_of(self.external))

    # declarations

    def attributes(self, s: str, p: int) -> int:
        while s[p] in (self.c["__attribute__"], self.c["__declspec"], self.c["_Alignas"], self.c["__asm__"], self.c["asm"]) and s[p + 1] in self.can["any"]:
            p += 2
        return p

    def specifiers(self, s: str, p: int) -> int:
        """The type and qualifiers of a declaration; there must be a type."""
        c = self.c
        typed = False
        while True:
            p = self.attributes(s, p)
            x = s[p]
            if x in self.qualifiers:
                p += 1
            elif x in self.types:
                p += 1
                typed = True
            elif x in (c["struct"], c["union"], c["enum"]) and not typed:
                p = self.attributes(s, p + 1)
                body = "enumerators" if x == c["enum"] else "fields"
                if s[p] == c["ID"]:
                    p += 1
                    if s[p] in self.can[body]:
                        p += 1
                else:
                    p = self.group(s, p, body)
                typed = True
            elif x in (c["typeof"], c["__typeof__"]) and not typed:
                p = self.group(s, p + 1, "any")
                typed = True
            elif x == c["ID"] and not typed:
                p += 1
                typed = True
            else:
                break
        if not typed:
            raise Bad("type")
        return p

    def pointers(self, s: str, p: int) -> int:
        while s[p] == self.c["*"] or (s[p] in self.qualifiers and s[p - 1] == self.c["*"]) or (s[p] in self.qualifiers and s[p - 1] in self.qualifiers):
            p += 1
        return self.attributes(s, p)

    def declarator(self, s: str, p: int, named: bool | None) -> int:
        """``named``: True for a name, False for none, None for either."""
        c, can = self.c, self.can
        p = self.pointers(s, p)
        if s[p] == c["ID"] and named is not False:
            p += 1
        elif s[p] in can["declarator"] and named is not False:
            p += 1
        elif named:
            raise Bad("declarator")
        elif s[p] in can["any"] and s[p + 1] in can["params"]:
            p += 1
        while s[p] in can["params"] or s[p] in can["size"]:
            p += 1
        return self.attributes(s, p)

    def param(self, s: str, p: int) -> int:
        if s[p] == self.c["..."]:
            return p + 1
        p = self.specifiers(s, p)
        return self.declarator(s, p, None)

    def type_name(self, s: str, p: int) -> int:
        return self.declarator(s, self.specifiers(s, p), False)

    def field(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c[";"]:
            return p + 1
        p = self.specifiers(s, p)
        while s[p] != c[";"]:
            if s[p] != c[":"]:
                p = self.declarator(s, p, True)
            if s[p] == c[":"]:
                p = self.assignment(s, p + 1)
            if s[p] == c[","]:
                p += 1
            elif s[p] != c[";"]:
                raise Bad("field")
        return p + 1

    def enumerator(self, s: str, p: int) -> int:
        p = self.need(s, p, "ID")
        return self.assignment(s, p + 1) if s[p] == self.c["="] else p

    def initializer(self, s: str, p: int) -> int:
        c = self.c
        q = p
        while s[q] in self.can["size"] or (s[q] == c["."] and s[q + 1] == c["ID"]):
            q += 1 if s[q] in self.can["size"] else 2
        if q > p:
            p = self.need(s, q, "=")
        return p + 1 if s[p] in self.can["init"] else self.assignment(s, p)

    def declarators(self, s: str, p: int) -> int:
        c = self.c
        while True:
            p = self.declarator(s, p, True)
            if s[p] == c["="]:
                p += 1
                p = p + 1 if s[p] in self.can["init"] else self.assignment(s, p)
            if s[p] != c[","]:
                return p
            p += 1

    def declaration(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["_Static_assert"]:
            return self.need(s, self.group(s, p + 1, "args"), ";")
        p = self.specifiers(s, p)
        return p + 1 if s[p] == c[";"] else self.need(s, self.declarators(s, p), ";")

    def external(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c[";"]:
            return p + 1
        if s[p] in (c["asm"], c["__asm__"]):
            return self.need(s, self.group(s, p + 1, "any"), ";")
        q = self.attempt(self.declaration, s, p)
        if q >= 0:
            return q
        q = self.attempt(lambda s, p: self.declarator(s, self.specifiers(s, p), True), s, p)
        p = q if q >= 0 else self.declarator(s, p, True)  # an old function may have no type
        if s[p - 1] not in self.can["params"]:
            raise Bad("function")
        while s[p] not in self.can["block"]:
            p = self.declaration(s, p)
        return p + 1

    # expressions

    def comma(self, s: str, p: int) -> int:
        p = self.assignment(s, p)
        while s[p] == self.c[","]:
            p = self.assignment(s, p + 1)
        return p

    def argument(self, s: str, p: int) -> int:
        q = self.attempt(self.assignment, s, p)
        return q if q >= 0 and s[q] in (END, self.c[","]) else self.type_name(s, p)

    def size(self, s: str, p: int) -> int:
        while s[p] in self.qualifiers:
            p += 1
        if s[p] == END:
            return p
        return p + 1 if s[p] == self.c["*"] and s[p + 1] == END else self.assignment(s, p)

    def assignment(self, s: str, p: int) -> int:
        c = self.c
        p = self.unit(s, p)
        while True:
            if s[p] in self.binary:
                p = self.unit(s, p + 1)
            elif s[p] == c["?"]:
                p = p + 2 if s[p + 1] == c[":"] else self.need(s, self.comma(s, p + 1), ":")
                p = self.assignment(s, p)
            else:
                return p

    def unit(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        while True:
            x = s[p]
            if x in self.prefix:
                p += 1
            elif x == c["sizeof"] or x == c["_Alignof"]:
                if s[p + 1] in can["typename"]:
                    p += 2
                    if s[p] in can["init"]:
                        p += 1
                    return p
                p += 1
            elif x in can["typename"] and self.starts_operand(s[p + 1], x in can["expr"]):
                p += 1
            else:
                break
        x = s[p]
        if x == c["STR"]:
            p += 1
            while s[p] in (c["STR"], c["ID"]):
                p += 1
        elif x == c["ID"] or x == c["LIT"]:
            p += 1
            while s[p] == c["STR"]:
                p += 1
        elif x == c["_Generic"]:
            p = self.group(s, p + 1, "any")
        elif x in can["expr"] or x in can["init"] and s[p - 1] in can["typename"]:
            p += 1
        else:
            raise Bad("operand")
        while True:
            x = s[p]
            if x in can["args"]:
                p += 1
            elif x in can["size"]:
                p += 1
            elif x in (c["."], c["->"]):
                p = self.need(s, p + 1, "ID")
            elif x in (c["++"], c["--"]):
                p += 1
            else:
                return p

    def starts_operand(self, x: str, also_value: bool) -> bool:
        c = self.c
        if x in (c["ID"], c["LIT"], c["STR"], c["sizeof"], c["!"], c["~"]) or x in self.can["init"] or (x in self.can["typename"] and not also_value):
            return True
        if x in self.can["expr"]:
            return not also_value
        return not also_value and x in self.prefix

    # statements

    def for_head(self, s: str, p: int) -> int:
        c = self.c
        q = self.attempt(self.declaration, s, p)
        p = q if q >= 0 else p + 1 if s[p] == c[";"] else self.need(s, self.comma(s, p), ";")
        if s[p] != c[";"]:
            p = self.comma(s, p)
        p = self.need(s, p, ";")
        return p if s[p] == END else self.comma(s, p)

    def statement(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        x = s[p]
        if x == c[";"] or x in can["block"]:
            return p + 1
        if x == c["if"]:
            p = self.statement(s, self.group(s, p + 1, "expr"))
            return self.statement(s, p + 1) if s[p] == c["else"] else p
        if x == c["for"]:
            return self.statement(s, self.group(s, p + 1, "forhead"))
        if x in (c["while"], c["switch"]):
            return self.statement(s, self.group(s, p + 1, "expr"))
        if x == c["do"]:
            p = self.need(s, self.statement(s, p + 1), "while")
            return self.need(s, self.group(s, p, "expr"), ";")
        if x == c["case"]:
            p = self.assignment_no_colon(s, p + 1)
            return self.labelled(s, self.need(s, p, ":"))
        if x == c["default"]:
            return self.labelled(s, self.need(s, p + 1, ":"))
        if x == c["return"]:
            return p + 2 if s[p + 1] == c[";"] else self.need(s, self.comma(s, p + 1), ";")
        if x in (c["break"], c["continue"]):
            return self.need(s, p + 1, ";")
        if x == c["goto"]:
            return self.need(s, self.need(s, p + 1, "ID"), ";")
        if x in (c["asm"], c["__asm__"]):
            p += 1
            while s[p] in self.qualifiers:
                p += 1
            return self.need(s, self.group(s, p, "any"), ";")
        if x == c["ID"] and s[p + 1] == c[":"]:
            return self.labelled(s, p + 2)
        q = self.attempt(lambda s, p: self.need(s, self.comma(s, p), ";"), s, p)
        return q if q >= 0 else self.declaration(s, p)

    def assignment_no_colon(self, s: str, p: int) -> int:
        p = self.unit(s, p)
        while s[p] in self.binary or s[p] == self.c["..."]:
            p = self.unit(s, p + 1)
        return p

    def labelled(self, s: str, p: int) -> int:
        return p if s[p] == END else self.statement(s, p)


@lru_cache(maxsize=1)
def _c() -> _C:
    return _C()


@dataclass
class _Branch:
    """A branch of a conditional: ``chain`` is its conditional, ``start`` and ``width`` the readings of that in which it is taken."""

    chain: _Chain
    start: int
    width: int


@dataclass
class _Chain:
    width: int = 0
    decided: bool = False


def _branch(chain: _Chain, condition: str) -> _Branch:
    """The next branch of a conditional; none is taken whose condition is 0, or behind one whose condition is 1."""
    width = 0 if chain.decided or condition == "0" else 1
    chain.decided |= condition == "1"
    return _Branch(chain, chain.width, width)


def _reading(events: list, k: int) -> str:
    """The tokens of reading ``k`` of a text; conditionals with fewer readings are in their last."""
    out: list[str] = []
    stack = [(True, k)]
    for e in events:
        if isinstance(e, str):
            if stack[-1][0]:
                out.append(e)
        elif e is None:
            stack.pop()
        else:
            first, b = e
            if not first:
                stack.pop()
            on, outer = stack[-1]
            at = min(outer, b.chain.width - 1) - b.start
            stack.append((on and 0 <= at < b.width, at))
    return "".join(out)


def c(text: str) -> None:
    """Every branch of every conditional must parse: each is taken in one reading of the text at least."""
    parser = _c()
    char, match = parser.c, _LEXER.match
    events: list = []
    open_: list[_Branch] = []
    readings = 1

    def close() -> None:
        b = open_[-1]
        b.chain.width = b.start + b.width

    at, n, fresh, probe, fed, plain = 0, len(text), True, PROBE, 0, Reduction(parser.g, "program")
    while at < n:
        if len(events) >= probe:
            new = list(itertools.takewhile(lambda e: isinstance(e, str), events[fed:]))  # readings part at the first conditional
            plain.probe("".join(new))
            probe, fed = 2 * len(events) if len(new) == len(events) - fed else n + 1, len(events)
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "nl":
            fresh = True
            continue
        if kind == "end":
            break
        tok = text[start:at]
        if kind == "pp":
            if not fresh or not _DIRECTIVE.match(tok):
                raise Bad("directive")
            word = re.match(r"#[ \t]*(\w*)", tok).group(1)  # type: ignore[union-attr]
            fixed = re.match(r"#[ \t]*(?:el)?if[ \t]*\(?[ \t]*([01])[ \t]*\)?[ \t]*(?:/[/*].*)?$", tok)
            condition = fixed.group(1) if fixed else ""
            if word in ("if", "ifdef", "ifndef"):
                open_.append(_branch(_Chain(), condition))
                events.append((True, open_[-1]))
            elif word in ("elif", "else"):
                if not open_:
                    raise Bad("directive")
                close()
                open_[-1] = _branch(open_[-1].chain, condition)
                events.append((False, open_[-1]))
            elif word == "endif":
                if not open_:
                    raise Bad("directive")
                close()
                width = open_.pop().chain.width
                events.append(None)
                if open_:
                    open_[-1].width = max(open_[-1].width, width) if open_[-1].width else 0
                else:
                    readings = max(readings, width)
            continue
        fresh = False
        if kind == "word":
            tok = tok if tok in _HARD else "ID"
        elif kind == "str":
            tok = "STR"
        elif kind != "op":
            tok = "LIT"
        events.append(char[tok])
    if open_:
        raise Bad("conditional")
    last = None
    for k in range(readings):
        tokens = _reading(events, k)
        if tokens != last:
            parser.g.run(tokens, "program")
        last = tokens
