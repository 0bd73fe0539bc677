"""Go."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from lodesift.llm.grammars.engine import AT_ONCE, Bad, END, Flat, Grammar, PROBE, Reduction, Tokens, flat_pattern, operators, token_pattern

_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_HARD = frozenset(_WORDS)
_OPS = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( ) [ ] { } , ; . : ~".split()
_PARTS = {
    "word": r"[^\W\d]\w*+",
    "nl": r"\n",
    "bc": r"/\*.*?\*/",
    "num": r"(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?(?!\w)",
    "str": r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`",
    "chr": r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'",
    "op": operators(_OPS),
}
_SKIP = r"(?:[ \t\r]|//[^\n]*)*+"
_LEXER = token_pattern(_PARTS, re.S, _SKIP)
_FLAT = flat_pattern(_PARTS, 0, _SKIP)
_SIGNS = frozenset(_OPS)
_ENDS = frozenset(["ID", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


class _Go(Flat):
    def __init__(self) -> None:
        g = Grammar(
            ["ID", "LIT", "STR", *_WORDS, *_OPS],
            {
                "brace": ["block", "composite", "struct", "interface", "switch", "select"],
                "paren": ["expr", "args", "params", "results", "specs_import", "specs_const", "specs_var", "specs_type", "typeparen"],
                "square": ["index", "arraytype", "slicetype", "tparams", "tlist"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square"},
        )
        super().__init__(g)
        self.SEMI = self.c[";"]
        self.prefix = g.set("+ - ! ^ * & <-")
        self.binary = g.set("+ - * / % & | ^ << >> &^ && || == < > != <= >=")
        self.assigns = g.set("= := += -= *= /= %= &= |= ^= <<= >>= &^=")
        t = g.tests
        t["block"] = self.whole(self.statements)
        t["composite"] = self.whole(self.elements)
        t["struct"] = self.whole(self.separated(self.field))
        t["interface"] = self.whole(self.separated(self.method))
        t["switch"] = self.whole(self.cases)
        t["select"] = self.whole(self.comm_cases)
        t["expr"] = self.whole(self.any_expr)
        t["args"] = self.whole(self.listed(self.argument))
        t["params"] = self.whole(self.listed(self.param))
        t["results"] = t["params"]
        t["specs_import"] = self.whole(self.separated(self.import_spec))
        t["specs_const"] = self.whole(self.separated(self.const_spec))
        t["specs_var"] = self.whole(self.separated(self.var_spec))
        t["specs_type"] = self.whole(self.separated(self.type_spec))
        t["typeparen"] = self.whole(self.type)
        t["index"] = self.whole(self.index)
        t["arraytype"] = self.whole(self.array_size)
        t["slicetype"] = self.whole(lambda s, p: p)
        t["tparams"] = self.whole(self.listed(self.type_params, empty=False))
        t["tlist"] = self.whole(self.listed(self.type, empty=False))
        t["program"] = self.whole(self.file)

    def separated(self, item):  # noqa: ANN001, ANN201 - a parser of items with semicolons between them
        def parse(s: str, p: int) -> int:
            while True:
                while s[p] == self.SEMI:
                    p += 1
                if s[p] == END:
                    return p
                p = item(s, p)
                if s[p] not in (END, self.SEMI):
                    raise Bad("separator")

        return parse

    # types

    def type(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        x = s[p]
        if x == c["ID"]:
            p += 1
            if s[p] == c["."] and s[p + 1] == c["ID"]:
                p += 2
            return p + 1 if s[p] in can["tlist"] else p
        if x == c["*"]:
            return self.type(s, p + 1)
        if x in can["slicetype"] or x in can["arraytype"]:
            return self.type(s, p + 1)
        if x == c["map"]:
            return self.type(s, self.group(s, p + 1, "tlist"))
        if x == c["<-"]:
            return self.type(s, self.need(s, p + 1, "chan"))
        if x == c["chan"]:
            p += 1
            return self.type(s, p + 1 if s[p] == c["<-"] else p)
        if x == c["func"]:
            return self.signature(s, p + 1)
        if x == c["struct"]:
            return self.group(s, p + 1, "struct")
        if x == c["interface"]:
            return self.group(s, p + 1, "interface")
        return self.group(s, p, "typeparen")

    def array_size(self, s: str, p: int) -> int:
        return p + 1 if s[p] == self.c["..."] else self.expr(s, p)

    def signature(self, s: str, p: int) -> int:
        p = self.group(s, p, "params")
        if s[p] in self.can["results"]:
            return p + 1
        q = self.attempt(self.type, s, p)
        return q if q >= 0 else p

    def param(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["ID"]:
            q = p + 1
            if s[q] == c["..."]:
                return self.type(s, q + 1)
            q = self.attempt(self.type, s, q)
            if q >= 0 and s[q] in (END, c[","]):
                return q
        if s[p] == c["..."]:
            p += 1
        return self.type(s, p)

    def type_params(self, s: str, p: int) -> int:
        c = self.c
        p = self.need(s, p, "ID")
        return p if s[p] in (END, c[","]) else self.constraint(s, p)

    def constraint(self, s: str, p: int) -> int:
        c = self.c
        while True:
            if s[p] == c["~"]:
                p += 1
            p = self.type(s, p)
            if s[p] != c["|"]:
                return p
            p += 1

    def field(self, s: str, p: int) -> int:
        c = self.c
        q = p
        if s[p] == c["ID"] and s[p + 1] not in (c["."], END, self.SEMI, c["STR"]):
            q = p + 1
            while s[q] == c[","]:
                q = self.need(s, q + 1, "ID")
            r = self.attempt(self.type, s, q)
            q = r if r >= 0 else self.type(s, p)
        else:
            q = self.type(s, p)
        return q + 1 if s[q] == c["STR"] else q

    def method(self, s: str, p: int) -> int:
        if s[p] == self.c["ID"] and s[p + 1] in self.can["params"]:
            return self.signature(s, p + 1)
        return self.constraint(s, p)

    # expressions; ``bare`` is the head of a statement, where a brace opens its block

    def any_expr(self, s: str, p: int) -> int:
        q = self.attempt(self.expr, s, p)
        return q if q >= 0 and s[q] == END else self.type(s, p)

    def argument(self, s: str, p: int) -> int:
        c = self.c
        q = self.attempt(self.expr, s, p)
        if q >= 0 and s[q] in (END, c[","], c["..."], c[":"]):
            return q + 1 if s[q] == c["..."] else q
        return self.type(s, p)

    def index(self, s: str, p: int) -> int:
        c = self.c
        colons = 0
        if s[p] != c[":"]:
            p = self.argument(s, p)
            while s[p] == c[","]:
                p = self.argument(s, p + 1)
                colons = 9
        while s[p] == c[":"] and colons < 2:
            colons += 1
            p += 1
            if s[p] not in (END, c[":"]):
                p = self.expr(s, p)
        return p

    def expr(self, s: str, p: int, bare: bool = False) -> int:
        p = self.unit(s, p, bare)
        while s[p] in self.binary:
            p = self.unit(s, p + 1, bare)
        return p

    def unit(self, s: str, p: int, bare: bool) -> int:
        c, can = self.c, self.can
        while s[p] in self.prefix:
            p += 1
        x = s[p]
        if x == c["func"]:
            p = self.signature(s, p + 1)
            if s[p] in can["block"]:
                p += 1
        elif x == c["LIT"] or x == c["STR"]:
            p += 1
        elif x == c["ID"]:
            p += 1
            if not bare and s[p] in can["composite"]:
                p += 1
        elif x in (c["map"], c["struct"], c["chan"], c["interface"]) or x in can["slicetype"] or x in can["arraytype"]:
            p = self.type(s, p)
            if s[p] in can["composite"]:
                p += 1
            elif s[p] not in can["args"]:
                raise Bad("conversion")
        elif x in can["expr"]:
            p += 1
        else:
            raise Bad("operand")
        while True:
            x = s[p]
            if x == c["."]:
                p += 1
                if s[p] == c["ID"]:
                    p += 1
                elif s[p] in can["expr"] or s[p] in can["typeparen"]:
                    p += 1
                else:
                    raise Bad("selector")
                if not bare and s[p] in can["composite"] and s[p - 1] == c["ID"]:
                    p += 1
            elif x in can["args"] or x in can["index"]:
                p += 1
                if not bare and x in can["tlist"] and s[p] in can["composite"]:
                    p += 1
            elif x == c["type"]:
                raise Bad("type")
            else:
                return p

    def elements(self, s: str, p: int) -> int:
        c = self.c
        while s[p] != END:
            for i in (0, 1):
                p = p + 1 if s[p] in self.can["composite"] else self.expr(s, p)
                if i == 0 and s[p] == c[":"]:
                    p += 1
                else:
                    break
            if s[p] == c[","]:
                p += 1
            elif s[p] != END:
                raise Bad("element")
        return p

    # declarations

    def import_spec(self, s: str, p: int) -> int:
        if s[p] in (self.c["ID"], self.c["."]):
            p += 1
        return self.need(s, p, "STR")

    def names(self, s: str, p: int) -> int:
        p = self.need(s, p, "ID")
        while s[p] == self.c[","]:
            p = self.need(s, p + 1, "ID")
        return p

    def exprs(self, s: str, p: int, bare: bool = False) -> int:
        p = self.expr(s, p, bare)
        while s[p] == self.c[","]:
            p = self.expr(s, p + 1, bare)
        return p

    def const_spec(self, s: str, p: int) -> int:
        c = self.c
        p = self.names(s, p)
        if s[p] not in (c["="], END, self.SEMI):
            p = self.type(s, p)
        return self.exprs(s, p + 1) if s[p] == c["="] else p

    def var_spec(self, s: str, p: int) -> int:
        c = self.c
        p = self.names(s, p)
        if s[p] != c["="]:
            p = self.type(s, p)
        return self.exprs(s, p + 1) if s[p] == c["="] else p

    def type_spec(self, s: str, p: int) -> int:
        p = self.need(s, p, "ID")
        if s[p] in self.can["tparams"] and s[p] not in self.can["slicetype"]:
            q = self.attempt(self.type, s, p + 1)
            if q >= 0 and s[q] in (END, self.SEMI):
                return q
        if s[p] == self.c["="]:
            p += 1
        return self.type(s, p)

    def declaration(self, s: str, p: int) -> int:
        kind = self.g.token[s[p]]
        spec = {"import": self.import_spec, "const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[kind]
        return p + 2 if s[p + 1] in self.can["specs_" + kind] else spec(s, p + 1)

    def file(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == self.SEMI:
            p += 1
        p = self.need(s, self.need(s, p, "package"), "ID")
        heads = self.g.set("import const var type")
        while s[p] != END:
            p = self.need(s, p, ";")
            while s[p] == self.SEMI:
                p += 1
            if s[p] in heads:
                p = self.declaration(s, p)
            elif s[p] == c["func"]:
                p += 1
                if s[p] in self.can["params"]:
                    p += 1
                p = self.need(s, p, "ID")
                if s[p] in self.can["tparams"]:
                    p += 1
                p = self.signature(s, p)
                if s[p] in self.can["block"]:
                    p += 1
            elif s[p] != END:
                raise Bad("declaration")
        return p

    # statements

    def statements(self, s: str, p: int) -> int:
        while True:
            while s[p] == self.SEMI:
                p += 1
            if s[p] == END:
                return p
            p = self.statement(s, p)
            if s[p] not in (END, self.SEMI):
                raise Bad("end")

    def simple(self, s: str, p: int, bare: bool) -> int:
        c = self.c
        p = self.exprs(s, p, bare)
        if s[p] in (c["++"], c["--"]):
            return p + 1
        if s[p] == c["<-"]:
            return self.expr(s, p + 1, bare)
        if s[p] in self.assigns:
            p += 1
            return self.expr(s, p + 1, bare) if s[p] == c["range"] else self.exprs(s, p, bare)
        return p

    def head(self, s: str, p: int) -> int:
        """``init; condition`` of an ``if`` or ``switch``."""
        if s[p] != self.SEMI and not (s[p] in self.can["block"] or s[p] in self.can["switch"]):
            p = self.simple(s, p, True)
        if s[p] == self.SEMI:
            p += 1
            if not (s[p] in self.can["block"] or s[p] in self.can["switch"]):
                p = self.simple(s, p, True)
        return p

    def statement(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        x = s[p]
        if x in can["block"]:
            return p + 1
        if x in (c["const"], c["var"], c["type"]):
            return self.declaration(s, p)
        if x == c["if"]:
            q = self.head(s, p + 1)
            if q == p + 1 or s[q - 1] == self.SEMI:
                raise Bad("condition")
            p = self.group(s, q, "block")
            if s[p] == c["else"]:
                return self.statement(s, p + 1) if s[p + 1] == c["if"] else self.group(s, p + 1, "block")
            return p
        if x == c["for"]:
            p += 1
            if s[p] in can["block"]:
                return p + 1
            if s[p] == c["range"]:
                return self.group(s, self.expr(s, p + 1, True), "block")
            if s[p] != self.SEMI:
                p = self.simple(s, p, True)
            if s[p] == self.SEMI:
                p += 1
                if s[p] != self.SEMI:
                    p = self.expr(s, p, True)
                p = self.need(s, p, ";")
                if s[p] not in can["block"]:
                    p = self.simple(s, p, True)
            return self.group(s, p, "block")
        if x == c["switch"]:
            return self.group(s, self.head(s, p + 1), "switch")
        if x == c["select"]:
            return self.group(s, p + 1, "select")
        if x == c["return"]:
            return p + 1 if s[p + 1] in (END, self.SEMI) else self.exprs(s, p + 1)
        if x in (c["go"], c["defer"]):
            return self.expr(s, p + 1)
        if x in (c["break"], c["continue"]):
            return p + 2 if s[p + 1] == c["ID"] else p + 1
        if x == c["goto"]:
            return self.need(s, p + 1, "ID")
        if x == c["fallthrough"]:
            return p + 1
        if x == c["ID"] and s[p + 1] == c[":"]:
            p += 2
            while s[p] == self.SEMI:
                p += 1
            return p if s[p] == END else self.statement(s, p)
        return self.simple(s, p, False)

    def cases(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == self.SEMI:
            p += 1
        while s[p] != END:
            if s[p] == c["case"]:
                p = self.argument(s, p + 1)
                while s[p] == c[","]:
                    p = self.argument(s, p + 1)
            else:
                p = self.need(s, p, "default")
            p = self.body(s, self.need(s, p, ":"))
        return p

    def comm_cases(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == self.SEMI:
            p += 1
        while s[p] != END:
            p = self.simple(s, p + 1, False) if s[p] == c["case"] else self.need(s, p, "default")
            p = self.body(s, self.need(s, p, ":"))
        return p

    def body(self, s: str, p: int) -> int:
        c = self.c
        while True:
            while s[p] == self.SEMI:
                p += 1
            if s[p] in (END, c["case"], c["default"]):
                return p
            p = self.statement(s, p)
            if s[p] not in (END, self.SEMI):
                raise Bad("end")


@lru_cache(maxsize=1)
def _go() -> _Go:
    return _Go()


def _named(text: str) -> str:
    """The name of a token by its text; line ends and comments over lines are a line end, other comments nothing."""
    first = text[:1]
    if first in ("", "\n") or text.startswith("/*"):
        return "" if not text or (first == "/" and "\n" not in text) else "\n"
    if text in _SIGNS or text in _HARD:
        return text
    if first in "\"`'":
        return "\x00" if len(text) == 1 else "LIT" if first == "'" else "STR"
    return "LIT" if first.isdigit() or (first == "." and len(text) > 1) else "ID" if first == "_" or first.isalpha() or text.isidentifier() else "\x00"


@lru_cache(maxsize=1)
def _at_once() -> tuple[Tokens, re.Pattern[str]]:
    c = _go().c
    return Tokens(c, _named), re.compile(f"(?<=[{''.join(re.escape(c[t]) for t in _ENDS)}])\n+")


def go(text: str) -> None:
    g = _go()
    char, match = g.c, _LEXER.match
    out: list[str] = []
    at, n, last, probe = 0, len(text), "", PROBE
    while at < n:
        if len(out) >= probe:
            Reduction(g.g, "program").probe(_guards(out, char))
            if at < n - AT_ONCE:  # it may be a program: the whole text is lexed at once
                tokens, ended = _at_once()
                s = tokens.read(_FLAT.findall(text))
                if "\x00" in s:
                    raise Bad("character")
                g.g.run(_guards(ended.sub(char[";"], s).replace("\n", ""), char), "program")
                return
            probe = 2 * len(out)
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "nl" or kind == "bc":
            if last in _ENDS and (kind == "nl" or "\n" in text[start:at]):
                out.append(char[";"])
                last = ";"
            continue
        if kind == "end":
            break
        tok = text[start:at]
        if kind == "word":
            tok = tok if tok in _HARD else "ID"
        elif kind == "str":
            tok = "STR"
        elif kind != "op":
            tok = "LIT"
        out.append(char[tok])
        last = tok
    g.g.run(_guards(out, char), "program")


def _guards(out: Iterable[str], char: dict[str, str]) -> str:
    """The tokens; the guard of a type switch reads as a selector of a parenthesised name."""
    return "".join(out).replace(char["("] + char["type"] + char[")"], char["("] + char["ID"] + char[")"])
