"""JavaScript modules and TypeScript."""

from __future__ import annotations

import re
from functools import lru_cache

from lodesift.llm.grammars.engine import AT_ONCE, Bad, END, Flat, Grammar, PROBE, Reduction, Tokens, flat_pattern, mark_angles, operators, token_pattern

_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
_SOFT = "async await of get set static let yield from as type interface namespace module declare abstract readonly public private protected implements keyof infer is asserts satisfies unique override out accessor".split()
_HARD = frozenset(_WORDS) | frozenset(_SOFT)
_OPS = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... # @".split()

_PARTS = {
    "word": r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})[\w$‌‍]*+",
    "nl": "[\n\r  ]",
    "bc": r"/\*.*?\*/",
    "num": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])",
    "str": r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    "tpl": "`",
    "op": operators(_OPS),
}
_SKIP = "[ \t\f\v\xa0﻿]*+(?://[^\n]*)?"
_LEXER = token_pattern(_PARTS, re.S, _SKIP)
_SIGNS = frozenset(_OPS)
_FLAT = flat_pattern(_PARTS | {"tpl": r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`/]*\})*+`|`", "op": r"\?(?=\.\d)|" + _PARTS["op"]}, 0, _SKIP)
_EMBEDDED = re.compile(r"\\.|\$\{([^{}`/]*)\}", re.S)
_RE_LITERAL = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_VALUE_END = frozenset(["ID", "NUM", "STR", "TPL", "RE", ")", "]", "}", "this", "super", "null", "true", "false", *_SOFT])
_ENDS = frozenset([*_VALUE_END, "++", "--", "return", "break", "continue", "debugger"])
_TS_ENDS = _ENDS | {"!", ">", "void"}
_GOES_ON = frozenset([".", "?.", ",", ";", ")", "]", ":", "?", "(", "[", "TPL", "=>", "in", "instanceof", *[o for o in _OPS if o not in ("{", "}", "!", "~", "++", "--", "...", "@", "#")]])
_TEMPLATE_PART = re.compile(r"[^`\\$]+|\\.|\$(?!\{)", re.S)


class _Script(Flat):
    """The parser of flat contents."""

    def __init__(self, ts: bool):
        g = Grammar(
            ["ID", "NUM", "STR", "TPL", "RE", "NL", *_WORDS, *_SOFT, *_OPS, "T<", "T>"],
            {
                "brace": ["block", "object", "class", "switch", "names", "members", "enumbody"],
                "paren": ["expr", "args", "params", "forhead", "typeparen"],
                "square": ["array", "index", "typesquare"],
                "angle": ["targs", "tparams"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square", "T< T>": "angle"},
        )
        super().__init__(g)
        self.ts = ts
        c = self.c
        self.ids = g.set("ID " + " ".join(_SOFT))
        self.names = self.ids | g.set(" ".join(_WORDS))
        self.literals = g.set("NUM STR TPL RE null true false this super")
        self.prefix = g.set("+ - ! ~ typeof void delete ++ --")
        self.binary = g.set("+ - * / % ** << & | ^ && || ?? < <= >= == != === !== = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= in instanceof")
        self.modifiers = g.set("static async get set *" + (" public private protected readonly abstract override declare accessor" if ts else ""))
        self.param_modifiers = g.set("public private protected readonly override") if ts else frozenset()
        self.type_words = g.set("void null true false this STR TPL NUM") if ts else frozenset()
        self.type_prefix = g.set("keyof readonly unique infer asserts abstract") if ts else frozenset()
        t = g.tests
        t["block"] = t["program"] = self.whole(self.run_of(self.statement))
        t["object"] = self.whole(self.listed(self.member), "NL")
        t["class"] = self.whole(self.run_of(self.class_member))
        t["switch"] = self.whole(self.cases)
        t["names"] = self.whole(self.listed(self.specifier), "NL")
        t["expr"] = t["index"] = self.whole(self.comma, "NL")
        t["args"] = self.whole(self.listed(self.spread), "NL")
        t["params"] = self.whole(self.listed(self.param), "NL")
        t["forhead"] = self.whole(self.for_head, "NL")
        t["array"] = self.whole(self.elements, "NL", empty=True)
        if ts:
            t["members"] = self.whole(self.type_members)
            t["enumbody"] = self.whole(self.listed(self.enum_member), "NL")
            t["typeparen"] = self.whole(self.type, "NL")
            t["typesquare"] = self.whole(self.type_square, "NL", empty=True)
            t["targs"] = self.whole(self.listed(self.type, empty=False), "NL")
            t["tparams"] = self.whole(self.listed(self.type_param, empty=False), "NL")
        else:
            for n in ("members", "enumbody", "typeparen", "typesquare", "targs", "tparams"):
                t[n] = self.never
        self.NL, self.COLON, self.ASSIGN, self.DOT, self.ARROW, self.QUESTION, self.GT = (c[x] for x in ("NL", ":", "=", ".", "=>", "?", ">"))

    def never(self, s: str) -> None:
        raise Bad("never")

    # types

    def type(self, s: str, p: int) -> int:
        p = self.union(s, p)
        while s[p] == self.c["extends"]:
            p = self.need(s, self.union(s, p + 1), "?")
            p = self.need(s, self.type(s, p), ":")
            p = self.type(s, p)
        return p

    def union(self, s: str, p: int) -> int:
        bars = (self.c["|"], self.c["&"])
        if s[p] in bars:
            p += 1
        p = self.single_type(s, p)
        while s[p] in bars:
            p = self.single_type(s, p + 1)
        return p

    def single_type(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        while s[p] in self.type_prefix and s[p + 1] not in (END, c[","], c[";"], c["="], self.NL, c[")"], c["|"], c["&"]) and s[p + 1] not in can["targs"]:
            p += 1
        if s[p] in self.ids and s[p + 1] == c["is"]:
            p += 2
        if s[p] == c["new"]:
            p += 1
        if s[p] in can["tparams"]:
            p += 1
            self.group(s, p, "params")
        if s[p] in can["params"] and s[p + 1] == self.ARROW:
            return self.type(s, p + 2)
        if s[p] == c["typeof"]:
            p += 1
        if s[p] == c["-"] and s[p + 1] == c["NUM"]:
            p += 1
        if s[p] == c["import"]:
            p = self.group(s, p + 1, "args")
            while s[p] == self.DOT:
                p += 2
        elif s[p] in self.type_words or s[p] in can["members"] or s[p] in can["typesquare"] or s[p] in can["typeparen"]:
            p += 1
        elif s[p] in self.ids:
            p += 1
            while s[p] == self.DOT and s[p + 1] in self.names:
                p += 2
        else:
            raise Bad("type")
        if s[p] in can["targs"]:
            p += 1
        while s[p] in can["typesquare"]:
            p += 1
        return p

    def type_param(self, s: str, p: int) -> int:
        c = self.c
        while s[p] in (c["const"], c["in"], c["out"]) and s[p + 1] in self.ids:
            p += 1
        if s[p] not in self.ids:
            raise Bad("type parameter")
        p += 1
        if s[p] == c["extends"]:
            p = self.union(s, p + 1)
        if s[p] == self.ASSIGN:
            p = self.type(s, p + 1)
        return p

    def type_members(self, s: str, p: int) -> int:
        c, ends = self.c, (self.c[";"], self.c[","], self.NL)
        while True:
            while s[p] in ends:
                p += 1
            if s[p] == END:
                return p
            while s[p] in (c["readonly"], c["get"], c["set"], c["+"], c["-"], c["new"]) and (s[p + 1] in self.names or s[p + 1] in self.can["typesquare"] or s[p + 1] == c["STR"] or (s[p] == c["new"] and s[p + 1] in self.can["params"])):
                p += 1
            if s[p] in self.names or s[p] in (c["STR"], c["NUM"]) or s[p] in self.can["typesquare"]:
                p += 1
            if s[p] in (c["+"], c["-"]):
                p += 1
            if s[p] == self.QUESTION:
                p += 1
            if s[p] in self.can["tparams"]:
                p += 1
            if s[p] in self.can["params"]:
                p += 1
            p = self.annotation(s, p)
            if s[p] not in ends and s[p] != END:
                raise Bad("member")

    def type_square(self, s: str, p: int) -> int:
        c = self.c
        q = self.attempt(self.listed(self.tuple_item), s, p)
        if q >= 0 and s[q] == END:
            return q
        if s[p] not in self.ids or s[p + 1] not in (self.COLON, c["in"]):
            raise Bad("index type")
        p = self.type(s, p + 2)
        return self.type(s, p + 1) if s[p] == c["as"] else p

    def tuple_item(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["..."]:
            p += 1
        if s[p] in self.ids and (s[p + 1] == self.COLON or (s[p + 1] == c["?"] and s[p + 2] == c[":"])):
            p += 2 if s[p + 1] == self.COLON else 3
        p = self.type(s, p)
        return p + 1 if s[p] == self.QUESTION else p

    def enum_member(self, s: str, p: int) -> int:
        if s[p] not in self.names and s[p] != self.c["STR"]:
            raise Bad("enum")
        p += 1
        return self.asg(s, p + 1) if s[p] == self.ASSIGN else p

    def annotation(self, s: str, p: int) -> int:
        return self.type(s, p + 1) if self.ts and s[p] == self.COLON else p

    # expressions

    def comma(self, s: str, p: int) -> int:
        p = self.asg(s, p)
        while s[p] == self.c[","]:
            p = self.asg(s, p + 1)
        return p

    def asg(self, s: str, p: int) -> int:
        p = self.unit(s, p)
        while True:
            x = s[p]
            if x in self.binary:
                p = self.unit(s, p + 1)
            elif x == self.GT:
                p += 1
                while s[p] == self.GT:
                    p += 1
                if s[p] in (self.ASSIGN, self.c[">="]):
                    p += 1
                p = self.unit(s, p)
            elif x == self.QUESTION:
                p = self.need(s, self.asg(s, p + 1), ":")
                p = self.asg(s, p)
            elif self.ts and x in (self.c["as"], self.c["satisfies"]):
                p = p + 2 if s[p + 1] == self.c["const"] else self.type(s, p + 1)
            else:
                return p

    def spread(self, s: str, p: int) -> int:
        return self.asg(s, p + 1 if s[p] == self.c["..."] else p)

    def elements(self, s: str, p: int) -> int:
        comma = self.c[","]
        while s[p] != END:
            while s[p] == comma:
                p += 1
            if s[p] == END:
                return p
            p = self.spread(s, p)
            if s[p] not in (comma, END):
                raise Bad("element")
        return p

    def arrow(self, s: str, p: int) -> int:
        """The place behind ``x =>`` or -1."""
        c = self.c
        if s[p] == c["async"] and (s[p + 1] in self.ids or s[p + 1] in self.can["params"] or s[p + 1] in self.can["tparams"]):
            q = self.arrow(s, p + 1)
            if q >= 0:
                return q
        if s[p] in self.ids and s[p + 1] == self.ARROW:
            return p + 2
        if s[p] in self.can["tparams"]:
            p += 1
        if s[p] in self.can["params"]:
            if s[p + 1] == self.ARROW:
                return p + 2
            if self.ts and s[p + 1] == self.COLON:
                q = self.attempt(self.type, s, p + 2)
                if q >= 0 and s[q] == self.ARROW:
                    return q + 1
        return -1

    def unit(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        while True:
            x = s[p]
            if x in self.prefix:
                p += 1
            elif x == c["new"] and s[p + 1] != self.DOT:
                p += 1
            elif x in (c["await"], c["yield"]) and s[p + 1] not in (self.ARROW, self.ASSIGN, self.DOT):
                y = s[p + 1]
                if x == c["yield"] and y == c["*"]:
                    p += 2
                elif y == END or y in (c[";"], c[","], self.NL, self.COLON):
                    return p + 1
                else:
                    p += 1
            elif self.ts and x in can["targs"] and self.arrow(s, p) < 0:
                p += 1
            else:
                break
        q = self.arrow(s, p)
        if q >= 0:
            return q + 1 if s[q] in can["block"] else self.asg(s, q)
        x = s[p]
        if x == c["function"] or (x == c["async"] and s[p + 1] == c["function"]):
            p = self.function(s, p, False)
        elif x in (c["class"], c["@"]) or (x == c["abstract"] and s[p + 1] == c["class"]):
            p = self.klass(s, p, False)
        elif x == c["import"]:
            if s[p + 1] == self.DOT:
                p += 3
            else:
                p = self.group(s, p + 1, "args")
        elif x == c["new"]:
            p += 3
        elif x == c["#"]:
            p += 2
        elif x in self.literals or x in self.ids or x in can["expr"] or x in can["array"] or x in can["object"]:
            p += 1
        else:
            raise Bad("operand")
        while True:
            x = s[p]
            if x == self.DOT:
                p += 1
                if s[p] == c["#"]:
                    p += 1
                if s[p] not in self.names:
                    raise Bad("name")
                p += 1
            elif x == c["?."]:
                p += 1
                if not (s[p] in self.names or s[p] in can["index"] or s[p] in can["args"] or s[p] == c["TPL"]):
                    raise Bad("chain")
                p += 1
            elif x in can["index"] or x in can["args"] or x == c["TPL"]:
                p += 1
            elif x in (c["++"], c["--"]):
                return p + 1
            elif self.ts and x == c["!"]:
                p += 1
            elif self.ts and x in can["targs"] and (s[p + 1] in can["args"] or s[p + 1] == c["TPL"] or s[p + 1] in (END, c[";"], self.NL, c[","])):
                p += 1
            else:
                return p

    # functions, classes and objects

    def function(self, s: str, p: int, declared: bool) -> int:
        c = self.c
        if s[p] == c["async"]:
            p += 1
        p = self.need(s, p, "function")
        if s[p] == c["*"]:
            p += 1
        if s[p] in self.ids:
            p += 1
        elif declared:
            raise Bad("function name")
        p = self.signature(s, p)
        if declared and self.ts and s[p] not in self.can["block"]:
            return self.end(s, p)
        return self.group(s, p, "block")

    def signature(self, s: str, p: int) -> int:
        if s[p] in self.can["tparams"]:
            p += 1
        return self.annotation(s, self.group(s, p, "params"))

    def param(self, s: str, p: int) -> int:
        c = self.c
        p = self.decorators(s, p)
        while s[p] in self.param_modifiers and (s[p + 1] in self.ids or s[p + 1] in self.can["array"] or s[p + 1] in self.can["object"]):
            p += 1
        if s[p] == c["..."]:
            p += 1
        p = self.target(s, p, c["this"])
        return self.asg(s, p + 1) if s[p] == self.ASSIGN else p

    def target(self, s: str, p: int, also: str = "") -> int:
        if not (s[p] in self.ids or s[p] in self.can["array"] or s[p] in self.can["object"] or (self.ts and s[p] == also)):
            raise Bad("target")
        p += 1
        if self.ts and s[p] in (self.QUESTION, self.c["!"]):
            p += 1
        return self.annotation(s, p)

    def decorators(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == c["@"]:
            if s[p + 1] in self.can["expr"]:
                p += 2
            else:
                p += 1
                if s[p] not in self.ids:
                    raise Bad("decorator")
                p += 1
                while s[p] == self.DOT:
                    p += 2
                if s[p] in self.can["args"]:
                    p += 1
            while s[p] == self.NL:
                p += 1
        return p

    def klass(self, s: str, p: int, declared: bool) -> int:
        c = self.c
        p = self.decorators(s, p)
        if s[p] == c["abstract"]:
            p += 1
        p = self.need(s, p, "class")
        if s[p] in self.ids and not (s[p] == c["implements"] and s[p + 1] in self.ids):
            p += 1
        elif declared:
            raise Bad("class name")
        if s[p] in self.can["tparams"]:
            p += 1
        if s[p] == c["extends"]:
            p = self.unit(s, p + 1) if s[p + 1] not in self.ids else self.heritage(s, p + 1)
        if self.ts and s[p] == c["implements"]:
            p = self.type(s, p + 1)
            while s[p] == c[","]:
                p = self.type(s, p + 1)
        return self.group(s, p, "class")

    def heritage(self, s: str, p: int) -> int:
        p += 1
        while True:
            if s[p] == self.DOT and s[p + 1] in self.names:
                p += 2
            elif s[p] in self.can["args"] or s[p] in self.can["targs"] or s[p] in self.can["index"]:
                p += 1
            else:
                return p

    def key(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["#"]:
            p += 1
        if s[p] in self.names or s[p] in (c["STR"], c["NUM"]) or s[p] in self.can["index"]:
            return p + 1
        raise Bad("key")

    def modified(self, s: str, p: int, stops: frozenset[str]) -> int:
        while s[p] in self.modifiers and s[p + 1] != END and s[p + 1] not in stops and s[p + 1] not in self.can["params"]:
            p += 1
            while s[p] == self.NL and s[p - 1] != self.c["*"]:
                p += 1
        return p

    def member(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["..."]:
            return self.asg(s, p + 1)
        p = self.modified(s, p, self.g.set(", : ="))
        start = p
        p = self.key(s, p)
        if s[p] in self.can["params"] or s[p] in self.can["tparams"]:
            return self.group(s, self.signature(s, p), "block")
        if s[p] == self.COLON:
            return self.asg(s, p + 1)
        if s[start] not in self.ids:
            raise Bad("member")
        return self.asg(s, p + 1) if s[p] == self.ASSIGN else p

    def class_member(self, s: str, p: int) -> int:
        c = self.c
        if s[p] in (self.NL, c[";"]):
            return p + 1
        if s[p] == c["static"] and s[p + 1] in self.can["block"]:
            return p + 2
        p = self.decorators(s, p)
        p = self.modified(s, p, self.g.set("= ; : ? NL !"))
        if self.ts and s[p] in self.can["typesquare"] and s[p + 1] == self.COLON and s[p] not in self.can["index"]:
            return self.end(s, self.annotation(s, p + 1))
        p = self.key(s, p)
        if self.ts and s[p] in (self.QUESTION, c["!"]):
            p += 1
        if s[p] in self.can["params"] or s[p] in self.can["tparams"]:
            p = self.signature(s, p)
            if s[p] in self.can["block"]:
                return p + 1
            if not self.ts:
                raise Bad("method")
            return self.end(s, p)
        p = self.annotation(s, p)
        if s[p] == self.ASSIGN:
            p = self.asg(s, p + 1)
        return self.end(s, p)

    def specifier(self, s: str, p: int) -> int:
        c = self.c
        if self.ts and s[p] == c["type"] and (s[p + 1] in self.names and s[p + 1] != c["as"]):
            p += 1
        for _ in range(2):
            if s[p] not in self.names and s[p] != c["STR"]:
                raise Bad("specifier")
            p += 1
            if s[p] != c["as"]:
                return p
            p += 1
        raise Bad("specifier")

    # statements

    def end(self, s: str, p: int) -> int:
        if s[p] in (self.NL, self.c[";"]):
            return p + 1
        if s[p] == END:
            return p
        raise Bad("end")

    def skip(self, s: str, p: int) -> int:
        while s[p] == self.NL:
            p += 1
        return p

    def variables(self, s: str, p: int) -> int:
        fixed = s[p] == self.c["const"] and not self.ts
        p += 1
        while True:
            p = self.target(s, p)
            if s[p] == self.ASSIGN:
                p = self.asg(s, p + 1)
            elif fixed:
                raise Bad("constant without value")
            if s[p] != self.c[","]:
                return p
            p += 1

    def starts_variables(self, s: str, p: int) -> bool:
        c = self.c
        return s[p] in (c["const"], c["var"]) or (s[p] == c["let"] and (s[p + 1] in self.ids or s[p + 1] in self.can["array"] or s[p + 1] in self.can["object"]))

    def for_head(self, s: str, p: int) -> int:
        c = self.c
        q = p + 1 if s[p] in (c["const"], c["let"], c["var"]) else p
        r = self.attempt(self.target if q > p else self.for_target, s, q)
        if r >= 0 and s[r] in (c["of"], c["in"]):
            return self.comma(s, r + 1)
        if s[p] != c[";"]:
            p = self.variables(s, p) if self.starts_variables(s, p) else self.comma(s, p)
        p = self.need(s, p, ";")
        if s[p] != c[";"]:
            p = self.comma(s, p)
        p = self.need(s, p, ";")
        return p if s[p] == END else self.comma(s, p)

    def for_target(self, s: str, p: int) -> int:
        return self.unit(s, p)

    def cases(self, s: str, p: int) -> int:
        c = self.c
        p = self.skip(s, p)
        while s[p] != END:
            if s[p] == c["case"]:
                p = self.comma(s, p + 1)
            elif s[p] == c["default"]:
                p += 1
            else:
                raise Bad("case")
            p = self.skip(s, self.need(s, p, ":"))
            while s[p] != END and s[p] not in (c["case"], c["default"]):
                p = self.statement(s, p)
        return p

    def statement(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        x = s[p]
        if x in (self.NL, c[";"]):
            return p + 1
        if x in can["block"]:
            return p + 1
        if x == c["if"]:
            p = self.statement(s, self.skip(s, self.group(s, p + 1, "expr")))
            q = self.skip(s, p)
            return self.statement(s, self.skip(s, q + 1)) if s[q] == c["else"] else p
        if x == c["for"]:
            p += 2 if s[p + 1] == c["await"] else 1
            return self.statement(s, self.skip(s, self.group(s, p, "forhead")))
        if x in (c["while"], c["with"]):
            return self.statement(s, self.skip(s, self.group(s, p + 1, "expr")))
        if x == c["do"]:
            p = self.skip(s, self.statement(s, self.skip(s, p + 1)))
            p = self.group(s, self.need(s, p, "while"), "expr")
            return p + 1 if s[p] in (self.NL, c[";"]) else p
        if x == c["switch"]:
            return self.group(s, self.skip(s, self.group(s, p + 1, "expr")), "switch")
        if x == c["try"]:
            q = p = self.group(s, p + 1, "block")
            p = self.skip(s, p)
            if s[p] == c["catch"]:
                p += 1
                if s[p] in can["params"]:
                    p += 1
                q = p = self.group(s, p, "block")
                p = self.skip(s, p)
                return self.group(s, p + 1, "block") if s[p] == c["finally"] else q
            return self.group(s, self.need(s, p, "finally"), "block")
        if x == c["return"]:
            p += 1
            return self.end(s, p if s[p] in (END, self.NL, c[";"]) else self.comma(s, p))
        if x == c["throw"]:
            return self.end(s, self.comma(s, p + 1))
        if x in (c["break"], c["continue"]):
            p += 1
            return self.end(s, p + 1 if s[p] in self.ids else p)
        if x == c["debugger"]:
            return self.end(s, p + 1)
        if x == c["import"] and s[p + 1] not in can["args"] and s[p + 1] != self.DOT:
            return self.imported(s, p + 1)
        if x == c["export"]:
            return self.exported(s, p + 1)
        q = self.declaration(s, p)
        if q >= 0:
            return q
        if self.starts_variables(s, p):
            return self.end(s, self.variables(s, p))
        if x in self.ids and s[p + 1] == self.COLON:
            return self.statement(s, self.skip(s, p + 2))
        if x in can["object"] or x in (c["function"], c["class"]):
            raise Bad("statement")
        return self.end(s, self.comma(s, p))

    def declaration(self, s: str, p: int) -> int:
        """The place behind a declaration, or -1 if none starts here."""
        c = self.c
        x, y = s[p], s[p + 1] if s[p] != END else END
        if x == c["function"] or (x == c["async"] and y == c["function"]):
            return self.function(s, p, True)
        if x in (c["class"], c["@"]) or (self.ts and x == c["abstract"] and y == c["class"]):
            if x == c["@"]:
                q = self.decorators(s, p)
                if s[q] == c["export"]:
                    return self.exported(s, q + 1)
            return self.klass(s, p, True)
        if not self.ts:
            return -1
        if x == c["type"] and y in self.ids:
            p += 2
            if s[p] in self.can["tparams"]:
                p += 1
            return self.end(s, self.type(s, self.need(s, p, "=")))
        if x == c["interface"] and y in self.ids:
            p += 2
            if s[p] in self.can["tparams"]:
                p += 1
            if s[p] == c["extends"]:
                p = self.union(s, p + 1)
                while s[p] == c[","]:
                    p = self.union(s, p + 1)
            return self.group(s, p, "members")
        if x == c["enum"] or (x == c["const"] and y == c["enum"]):
            p += 1 if x == c["enum"] else 2
            if s[p] not in self.ids:
                raise Bad("enum name")
            return self.group(s, p + 1, "enumbody")
        if x in (c["namespace"], c["module"]) and (y in self.ids or y == c["STR"]):
            p += 2
            while s[p] == self.DOT:
                p += 2
            return self.group(s, p, "block")
        if x == c["declare"] and (y in self.names) and s[p + 2] != self.ASSIGN:
            q = self.declaration(s, p + 1)
            return q if q >= 0 else self.end(s, self.variables(s, p + 1))
        return -1

    def source(self, s: str, p: int) -> int:
        c = self.c
        p = self.need(s, self.need(s, p, "from"), "STR")
        return self.group(s, p + 1, "object") if s[p] == c["with"] else p

    def imported(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["STR"]:
            return self.end(s, p + 1)
        if self.ts and s[p] == c["type"] and s[p + 1] != c["from"]:
            p += 1
        if s[p] in self.ids:
            p += 1
            if self.ts and s[p] == self.ASSIGN:
                return self.end(s, self.asg(s, p + 1))
            if s[p] == c[","]:
                p += 1
            else:
                return self.end(s, self.source(s, p))
        if s[p] == c["*"]:
            p = self.need(s, p + 1, "as")
            if s[p] not in self.ids:
                raise Bad("import")
            p += 1
        else:
            p = self.group(s, p, "names")
        return self.end(s, self.source(s, p))

    def exported(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["default"]:
            p += 1
            if s[p] == c["function"] or (s[p] == c["async"] and s[p + 1] == c["function"]):
                return self.function(s, p, False)
            if s[p] in (c["class"], c["@"]) or (s[p] == c["abstract"] and s[p + 1] == c["class"]):
                return self.klass(s, p, False)
            return self.end(s, self.asg(s, p))
        if s[p] == c["*"]:
            p += 1
            if s[p] == c["as"]:
                p += 2
            return self.end(s, self.source(s, p))
        if self.ts and s[p] == self.ASSIGN:
            return self.end(s, self.asg(s, p + 1))
        if s[p] == c["type"] and self.ts and s[p + 1] in self.can["names"]:
            p += 1
        if s[p] in self.can["names"]:
            p += 1
            return self.end(s, self.source(s, p) if s[p] == c["from"] else p)
        q = self.declaration(s, p)
        if q >= 0:
            return q
        if not self.starts_variables(s, p):
            raise Bad("export")
        return self.end(s, self.variables(s, p))


@lru_cache(maxsize=2)
def _script(ts: bool) -> _Script:
    return _Script(ts)


@lru_cache(maxsize=1)
def _angle_sets() -> tuple:
    c = _script(True).c
    inside = frozenset(c[t] for t in ["ID", "NUM", "STR", "TPL", "NL", *_SOFT, "void", "null", "true", "false", "this", "typeof", "extends", "new", "import", "in", "const", ",", ".", "|", "&", "?", ":", ";", "=>", "=", "...", "-", "+"])
    after = frozenset(c[t] for t in ["(", ")", "[", "]", "{", "}", ",", ";", ":", "?", ".", "=", "|", "&", ">", "=>", "NL", "TPL", "ID", "!", "extends", "implements", "&&", "||", "??", "?.", "===", "!==", "==", "!=", *_SOFT, "this", "new", "STR", "NUM", "null", "function", "instanceof"])
    return inside, after, {c["("]: c[")"], c["["]: c["]"], c["{"]: c["}"]}


def _named(text: str) -> str:
    """The name of a token by its text; line ends and comments over lines are a line end, other comments nothing."""
    first = text[:1]
    if first in ("", "\n", "\r", "\u2028", "\u2029") or text.startswith("/*"):
        return "" if not text or (first == "/" and "\n" not in text) else "\n"
    if first in "\"'":
        return "STR" if len(text) > 1 else "\x00"
    if first == "`":
        return "TPL"
    if first.isdigit() or (first == "." and text[1:2].isdigit()):
        return "NUM"
    if first in "$_\\" or first.isalpha() or text.isidentifier():
        return text if text in _HARD else "ID" if len(text) > 1 or first != "\\" else "\x00"
    return text if text in _SIGNS else "\x00"


@lru_cache(maxsize=2)
def _at_once(ts: bool) -> tuple:
    """The tokens of a dialect, and what is done to a text of them: names behind a dot, and line ends that end a statement."""
    c = _script(ts).c
    chars = lambda names: "".join(re.escape(c[n]) for n in names if n in c)
    behind_dot = re.compile(f"([{chars(['.', '?.'])}]\n*)[{chars(_HARD)}]")
    ended = re.compile(f"(?<=[{chars(_TS_ENDS if ts else _ENDS)}])\n+(?=[^{chars(_GOES_ON)}\n])|(?<=[{chars(['return', 'break', 'continue'])}])\n+(?=[^\n])")
    return Tokens(c, _named), behind_dot, r"\g<1>" + c["ID"], ended, c["NL"]


@lru_cache(maxsize=1)
def _lexed(text: str) -> list[str] | None:
    """The token texts of a whole text, or None where a slash may be a division or the start of a pattern, or a template embeds braces."""
    out = _FLAT.findall(text)
    return None if "/" in out or "/=" in out or "`" in out else out


@lru_cache(maxsize=1 << 12)
def _embeds(template: str, ts: bool) -> bool:
    """Whether all that a template embeds is an expression."""
    try:
        for m in _EMBEDDED.finditer(template):
            if m.group(1) is not None and _parse(m.group(1) + "}", 0, ts, True) != len(m.group(1)) + 1:
                return False
    except Bad:
        return False
    return True


def _whole(text: str, ts: bool) -> bool:
    """Parses a text lexed at once; False where it can't be."""
    texts = _lexed(text)
    if texts is None:
        return False
    tokens, behind_dot, name, ended, newline = _at_once(ts)
    s = tokens.read(texts)
    if "\x00" in s:
        raise Bad("character")
    if tokens.char["TPL"] in s and not all(_embeds(t, ts) for t in texts if t[:1] == "`"):
        raise Bad("template")
    s = ended.sub(newline, behind_dot.sub(name, s)).replace("\n", "")
    script = _script(ts)
    if ts and script.c["<"] in s:
        inside, after, nests = _angle_sets()
        out = list(s)
        mark_angles(out, script.c["<"], script.c[">"], (script.c["T<"], script.c["T>"]), inside, after, nests)
        s = "".join(out)
    script.g.run(s, "program")
    return True


def _template(text: str, at: int, ts: bool) -> int:
    """The end of a template that starts before ``at``; what it embeds must parse as an expression."""
    n = len(text)
    while at < n:
        m = _TEMPLATE_PART.match(text, at)
        if m:
            at = m.end()
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            at = _parse(text, at + 2, ts, True)
        else:
            break
    raise Bad("template")


def _finish(out: list[str], ts: bool, plain: Reduction, fed: int) -> None:
    """Parses all tokens; ``plain`` has the first ``fed`` of them, unless there are angles."""
    if ts and _script(ts).c["<"] in out:
        inside, after, nests = _angle_sets()
        c = _script(ts).c
        mark_angles(out, c["<"], c[">"], (c["T<"], c["T>"]), inside, after, nests)
        plain.g.run("".join(out), plain.top)
    else:
        plain.finish("".join(out[fed:]))


def _parse(text: str, at: int, ts: bool, inner: bool) -> int:
    """Parses from ``at``: a whole module, or (``inner``) up to the brace that ends an embedded expression."""
    char, match = _script(ts).c, _LEXER.match
    ends = _TS_ENDS if ts else _ENDS
    out: list[str] = []
    last, newline, depth, n = "", False, 0, len(text)
    probe, fed, plain, angle = n + 1 if inner else PROBE, 0, Reduction(_script(ts).g, "expr" if inner else "program"), char["<"]
    while at < n:
        if len(out) >= probe:
            new = "".join(out[fed:])
            plain.probe(new.split(angle, 1)[0] if ts else new)  # what an angle means is only known later
            if fed == 0 and at < n - AT_ONCE and _whole(text, ts):
                return n
            fed = len(out)
            probe = 2 * fed if not ts or angle not in new else n + 1
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        start, end = m.span(kind)
        if kind == "nl" or kind == "bc":
            newline = newline or kind == "nl" or "\n" in text[start:end]
            at = end
            continue
        if kind == "end":
            break
        at = start
        if kind == "word":
            tok = text[start:end]
            if tok not in _HARD or last == "." or last == "?.":
                tok = "ID"
        elif kind == "op":
            tok = text[start:end]
            if tok == "?." and text[end : end + 1].isdigit():
                tok, end = "?", at + 1
            if (tok == "/" or tok == "/=") and last not in _VALUE_END:
                r = _RE_LITERAL.match(text, at)
                if r is None:
                    raise Bad("regex")
                tok, end = "RE", r.end()
            elif tok == "{":
                depth += 1
            elif tok == "}":
                if inner and depth == 0:
                    _finish(out, ts, plain, fed)
                    return end
                depth -= 1
        elif kind == "tpl":
            tok, end = "TPL", _template(text, end, ts)
        else:
            tok = "NUM" if kind == "num" else "STR"
        if newline:
            if last in ends and (tok not in _GOES_ON or last in ("return", "break", "continue")):
                out.append(char["NL"])
            newline = False
        out.append(char[tok])
        last = tok
        at = end
    if inner:
        raise Bad("template")
    _finish(out, ts, plain, fed)
    return at


def javascript(text: str) -> None:
    _parse("//" + text if text.startswith("#!") else text, 0, False, False)


def typescript(text: str) -> None:
    _parse("//" + text if text.startswith("#!") else text, 0, True, False)
