"""PHP."""

from __future__ import annotations

import re
from functools import lru_cache

from lodesift.llm.grammars.engine import Bad, END, Flat, Grammar, PROBE, Reduction, operators, token_pattern

_WORDS = "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield from enum die self parent".split()
_HARD = frozenset(_WORDS)
_SOFT = ("enum", "readonly", "from", "self", "parent", "match")
_OPS = "{ } ( ) [ ] ; , . ... + - * / % ** = += -= *= /= .= %= **= &= |= ^= <<= >>= ??= == != <> === !== < > <= >= <=> && || ! & | ^ ~ << >> ++ -- ? ?? : :: -> ?-> => @ \\ # $".split()
_LEXER = token_pattern(
    {
        "var": r"\$[A-Za-z_\x80-\U0010ffff]\w*",
        "word": r"[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*",
        "blank": r"\s+",
        "close": r"\?>\n?",
        "attr": r"\#\[",
        "lc": r"(?://|\#)(?:(?!\?>)[^\n])*",
        "bc": r"/\*.*?\*/",
        "heredoc": r"<<<[ \t]*(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\n(?:.*?\n)??[ \t]*(?P=tag)\b",
        "cast": r"\((?i:[ \t]*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)[ \t]*)\)",
        "num": r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?!\w)",
        "str": r"[bB]?'(?:[^'\\]|\\.)*'|[bB]?\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`",
        "op": operators(_OPS),
    },
    re.S,
)
_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)


class _Php(Flat):
    def __init__(self) -> None:
        g = Grammar(
            ["VAR", "ID", "LIT", "CAST", "HTML", "#[", *_WORDS, *_OPS],
            {
                "brace": ["block", "class", "switch", "match", "index", "uses", "adapt"],
                "paren": ["expr", "args", "params", "forhead", "foreach", "catch", "useparen", "array", "typeparen", "exprlist"],
                "square": ["element", "list"],
                "attr": ["attribute"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square", "#[ ]": "attr"},
        )
        super().__init__(g)
        self.ids = g.set("ID " + " ".join(_SOFT))
        self.names = self.ids | g.set(" ".join(_WORDS))
        self.prefix = g.set("+ - ! ~ & @ ++ -- CAST clone print include include_once require require_once")
        self.binary = g.set(". + - * / % ** = += -= *= /= .= %= **= &= |= ^= <<= >>= ??= == != <> === !== < > <= >= <=> && || & | ^ << >> ?? and or xor instanceof")
        self.modifiers = g.set("public private protected static abstract final readonly var")
        t = g.tests
        t["block"] = t["program"] = self.whole(self.run_of(self.statement))
        t["class"] = self.whole(self.run_of(self.member))
        t["switch"] = self.whole(self.cases)
        t["match"] = self.whole(self.listed(self.arm))
        t["expr"] = t["index"] = self.whole(self.expression)
        t["element"] = self.whole(self.expression, empty=True)
        t["args"] = self.whole(self.listed(self.argument))
        t["exprlist"] = self.whole(self.listed(self.expression, empty=False))
        t["params"] = self.whole(self.listed(self.param))
        t["forhead"] = self.whole(self.for_head)
        t["foreach"] = self.whole(self.foreach)
        t["catch"] = self.whole(self.caught)
        t["useparen"] = self.whole(self.listed(self.used))
        t["array"] = t["list"] = self.whole(self.items, empty=True)
        t["typeparen"] = self.whole(self.type)
        t["uses"] = self.whole(self.listed(self.use_item))
        t["adapt"] = self.whole(self.run_of(self.adaptation))
        t["attribute"] = self.whole(self.listed(self.attribute, empty=False))

    def qualified(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["namespace"] and s[p + 1] == c["\\"]:
            p += 1
        if s[p] == c["\\"]:
            p += 1
        if s[p] not in self.ids and not (s[p] in self.names and s[p + 1] == c["\\"]):
            raise Bad("name")
        p += 1
        while s[p] == c["\\"] and s[p + 1] in self.names:
            p += 2
        return p

    def attributes(self, s: str, p: int) -> int:
        while s[p] in self.can["attribute"]:
            p += 1
        return p

    def attribute(self, s: str, p: int) -> int:
        p = self.qualified(s, p)
        return p + 1 if s[p] in self.can["args"] else p

    def type(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["?"]:
            p += 1
        while True:
            if s[p] in (c["array"], c["callable"], c["static"]) or s[p] in self.can["typeparen"]:
                p += 1
            else:
                p = self.qualified(s, p)
            if s[p] == c["|"] or (s[p] == c["&"] and s[p + 1] not in (c["VAR"], c["..."], c["&"])):
                p += 1
            else:
                return p

    # expressions

    def expression(self, s: str, p: int) -> int:
        c = self.c
        p = self.unit(s, p)
        while True:
            x = s[p]
            if x in self.binary:
                p += 1
                if s[p] == c["&"]:
                    p += 1
                p = self.unit(s, p)
            elif x == c["?"]:
                p += 1
                if s[p] != c[":"]:
                    p = self.expression(s, p)
                p = self.expression(s, self.need(s, p, ":"))
            else:
                return p

    def argument(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["..."]:
            p += 1
            if s[p] == END:
                return p
        elif s[p] in self.names and s[p + 1] == c[":"] :
            p += 2
        return self.expression(s, p)

    def items(self, s: str, p: int) -> int:
        c = self.c
        while s[p] != END:
            if s[p] == c[","]:
                p += 1
                continue
            if s[p] in (c["..."], c["&"]):
                p += 1
            p = self.expression(s, p)
            if s[p] == c["=>"]:
                p += 1
                if s[p] == c["&"]:
                    p += 1
                p = self.expression(s, p)
            if s[p] == c[","]:
                p += 1
            elif s[p] != END:
                raise Bad("item")
        return p

    def unit(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        p = self.attributes(s, p)
        while s[p] in self.prefix:
            p += 1
        x = s[p]
        if x == c["throw"]:
            return self.expression(s, p + 1)
        if x == c["yield"]:
            p += 1
            if s[p] == c["from"]:
                return self.expression(s, p + 1)
            if s[p] in (END, c[";"], c[","]):
                return p
            p = self.expression(s, p)
            return self.expression(s, p + 1) if s[p] == c["=>"] else p
        if x == c["new"]:
            p = self.creation(s, p + 1)
        elif x == c["static"] and s[p + 1] in (c["function"], c["fn"]) or x in (c["function"], c["fn"]):
            p = self.closure(s, p)
        elif x == c["match"] and s[p + 1] in can["expr"]:
            p = self.group(s, p + 2, "match")
        elif x in (c["array"], c["list"]) and s[p + 1] in can["array"]:
            p += 2
        elif x in (c["isset"], c["unset"]):
            p = self.group(s, p + 1, "exprlist")
        elif x == c["empty"]:
            p = self.group(s, p + 1, "expr")
        elif x in (c["exit"], c["die"]):
            p += 1
            if s[p] in can["args"]:
                p += 1
        elif x in (c["VAR"], c["LIT"], c["static"]) or x in can["expr"] or x in can["list"]:
            p += 1
        elif x == c["$"]:
            p += 1
            while s[p] == c["$"]:
                p += 1
            if s[p] != c["VAR"] and s[p] not in can["index"]:
                raise Bad("variable")
            p += 1
        else:
            p = self.qualified(s, p)
        while True:
            x = s[p]
            if x in (c["->"], c["?->"]):
                p += 1
                if s[p] in self.names or s[p] == c["VAR"] or s[p] in can["index"]:
                    p += 1
                elif s[p] == c["$"]:
                    p += 2
                else:
                    raise Bad("member")
            elif x == c["::"]:
                p += 1
                if s[p] in self.names or s[p] == c["VAR"] or s[p] in can["index"]:
                    p += 1
                elif s[p] == c["$"]:
                    p += 2
                else:
                    raise Bad("member")
            elif x in can["args"] or x in can["element"]:
                p += 1
            elif x in can["index"] and s[p - 1] == c["VAR"]:
                p += 1
            elif x in (c["++"], c["--"]):
                p += 1
            else:
                return p

    def creation(self, s: str, p: int) -> int:
        c = self.c
        p = self.attributes(s, p)
        if s[p] == c["readonly"] and s[p + 1] == c["class"]:
            p += 1
        if s[p] == c["class"]:
            p += 1
            if s[p] in self.can["args"]:
                p += 1
            return self.group(s, self.heritage(s, p), "class")
        if s[p] in (c["static"], c["VAR"]) or s[p] in self.can["expr"]:
            p += 1
            while s[p] in (c["->"], c["::"]) and (s[p + 1] in self.names or s[p + 1] == c["VAR"]):
                p += 2
            while s[p] in self.can["element"]:
                p += 1
        else:
            p = self.qualified(s, p)
        return p + 1 if s[p] in self.can["args"] else p

    def closure(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["static"]:
            p += 1
        arrow = s[p] == c["fn"]
        p += 1
        if s[p] == c["&"]:
            p += 1
        p = self.group(s, p, "params")
        if s[p] == c["use"] and not arrow:
            p = self.group(s, p + 1, "useparen")
        p = self.returns(s, p)
        return self.expression(s, self.need(s, p, "=>")) if arrow else self.group(s, p, "block")

    def used(self, s: str, p: int) -> int:
        return self.need(s, p + 1 if s[p] == self.c["&"] else p, "VAR")

    def returns(self, s: str, p: int) -> int:
        return self.type(s, p + 1) if s[p] == self.c[":"] else p

    def arm(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["default"]:
            p += 1
            if s[p] == c[","]:
                p += 1
        else:
            p = self.expression(s, p)
            while s[p] == c[","]:
                if s[p + 1] == c["=>"]:
                    p += 1
                    break
                p = self.expression(s, p + 1)
        return self.expression(s, self.need(s, p, "=>"))

    # declarations

    def param(self, s: str, p: int) -> int:
        c = self.c
        p = self.attributes(s, p)
        while s[p] in self.modifiers:
            p += 1
        if s[p] not in (c["VAR"], c["&"], c["..."]):
            p = self.type(s, p)
        if s[p] == c["&"]:
            p += 1
        if s[p] == c["..."]:
            p += 1
        p = self.need(s, p, "VAR")
        return self.expression(s, p + 1) if s[p] == c["="] else p

    def heritage(self, s: str, p: int) -> int:
        c = self.c
        for word in ("extends", "implements"):
            if s[p] == c[word]:
                p = self.qualified(s, p + 1)
                while s[p] == c[","]:
                    p = self.qualified(s, p + 1)
        return p

    def assigned(self, s: str, p: int, first: str) -> int:
        """``name = value`` with commas between; the value may be missing for variables."""
        c = self.c
        while True:
            if first == "VAR":
                p = self.need(s, p, "VAR")
            elif s[p] in self.names:
                p += 1
            else:
                raise Bad("name")
            if s[p] == c["="]:
                p = self.expression(s, p + 1)
            elif first != "VAR":
                raise Bad("value")
            if s[p] != c[","]:
                return p
            p += 1

    def member(self, s: str, p: int) -> int:
        c = self.c
        p = self.attributes(s, p)
        if s[p] == c["use"]:
            p = self.qualified(s, p + 1)
            while s[p] == c[","]:
                p = self.qualified(s, p + 1)
            return p + 1 if s[p] in self.can["adapt"] and s[p] != c[";"] else self.need(s, p, ";")
        if s[p] == c["case"]:
            if s[p + 1] not in self.names:
                raise Bad("case")
            p += 2
            if s[p] == c["="]:
                p = self.expression(s, p + 1)
            return self.need(s, p, ";")
        q = p
        while s[p] in self.modifiers:
            p += 1
        if s[p] == c["const"]:
            p += 1
            if s[p + 1] != c["="]:
                p = self.type(s, p)
            return self.need(s, self.assigned(s, p, "ID"), ";")
        if s[p] == c["function"]:
            p += 1
            if s[p] == c["&"]:
                p += 1
            if s[p] not in self.names:
                raise Bad("method")
            p = self.returns(s, self.group(s, p + 1, "params"))
            return p + 1 if s[p] in self.can["block"] else self.need(s, p, ";")
        if p == q:
            raise Bad("member")
        if s[p] != c["VAR"]:
            p = self.type(s, p)
        return self.need(s, self.assigned(s, p, "VAR"), ";")

    def adaptation(self, s: str, p: int) -> int:
        c = self.c
        while s[p] not in (END, c[";"]):
            p += 1
        return self.need(s, p, ";")

    def use_item(self, s: str, p: int) -> int:
        c = self.c
        if s[p] in (c["function"], c["const"]):
            p += 1
        p = self.qualified(s, p)
        if s[p] == c["as"]:
            if s[p + 1] not in self.ids:
                raise Bad("alias")
            p += 2
        return p

    # statements

    def for_head(self, s: str, p: int) -> int:
        c = self.c
        for i in range(3):
            while s[p] not in (END, c[";"]):
                p = self.expression(s, p)
                if s[p] == c[","]:
                    p += 1
            if i < 2:
                p = self.need(s, p, ";")
        return p

    def foreach(self, s: str, p: int) -> int:
        c = self.c
        p = self.need(s, self.expression(s, p), "as")
        for _ in range(2):
            if s[p] == c["&"]:
                p += 1
            p = self.unit(s, p)
            if s[p] != c["=>"]:
                return p
            p += 1
        raise Bad("foreach")

    def caught(self, s: str, p: int) -> int:
        p = self.qualified(s, p)
        while s[p] == self.c["|"]:
            p = self.qualified(s, p + 1)
        return p + 1 if s[p] == self.c["VAR"] else p

    def cases(self, s: str, p: int) -> int:
        c = self.c
        while s[p] != END:
            if s[p] == c["case"]:
                p = self.expression(s, p + 1)
            else:
                p = self.need(s, p, "default")
            if s[p] not in (c[":"], c[";"]):
                raise Bad("case")
            p += 1
            while s[p] not in (END, c["case"], c["default"], c["endswitch"]):
                p = self.statement(s, p)
            if s[p] == c["endswitch"]:
                return p
        return p

    def end(self, s: str, p: int) -> int:
        if s[p] == self.c[";"]:
            return p + 1
        if s[p] in (self.c["HTML"], END) and (s[p] != END or s[p - 1] == self.c["HTML"]):
            return p
        raise Bad("end")

    def body(self, s: str, p: int, *ends: str) -> int:
        """A statement, or ``: statements end;``."""
        c = self.c
        if s[p] != c[":"]:
            return self.statement(s, p)
        p += 1
        stops = [c[e] for e in ends]
        while s[p] not in stops:
            if s[p] == END:
                raise Bad(ends[0])
            p = self.statement(s, p)
        return p

    def statement(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        x = s[p]
        if x in (c[";"], c["HTML"]) or x in can["block"]:
            return p + 1
        if x == c["if"]:
            p = self.group(s, p + 1, "expr")
            if s[p] == c[":"]:
                p = self.body(s, p, "elseif", "else", "endif")
                while s[p] == c["elseif"]:
                    p = self.body(s, self.group(s, p + 1, "expr"), "elseif", "else", "endif")
                if s[p] == c["else"]:
                    p = self.body(s, p + 1, "endif")
                return self.end(s, self.need(s, p, "endif"))
            p = self.statement(s, p)
            while s[p] == c["elseif"]:
                p = self.statement(s, self.group(s, p + 1, "expr"))
            return self.statement(s, p + 1) if s[p] == c["else"] else p
        for word, head in (("for", "forhead"), ("foreach", "foreach"), ("while", "expr"), ("declare", "args")):
            if x == c[word]:
                p = self.group(s, p + 1, head if word != "declare" else "args")
                if word == "declare" and s[p] == c[";"]:
                    return p + 1
                if s[p] != c[":"]:
                    return self.statement(s, p)
                return self.end(s, self.need(s, self.body(s, p, "end" + word), "end" + word))
        if x == c["do"]:
            p = self.need(s, self.statement(s, p + 1), "while")
            return self.end(s, self.group(s, p, "expr"))
        if x == c["switch"]:
            p = self.group(s, p + 1, "expr")
            if s[p] == c[":"]:
                return self.end(s, self.need(s, self.cases(s, p + 1), "endswitch"))
            return self.group(s, p, "switch")
        if x == c["try"]:
            p = self.group(s, p + 1, "block")
            some = False
            while s[p] == c["catch"]:
                p = self.group(s, self.group(s, p + 1, "catch"), "block")
                some = True
            if s[p] == c["finally"]:
                return self.group(s, p + 1, "block")
            if not some:
                raise Bad("try")
            return p
        if x in (c["return"], c["break"], c["continue"]):
            return self.end(s, p + 1 if s[p + 1] in (c[";"], c["HTML"], END) else self.expression(s, p + 1))
        if x == c["echo"]:
            return self.end(s, self.listed(self.expression, trailing=False, empty=False)(s, p + 1))
        if x in (c["global"],) or (x == c["static"] and s[p + 1] == c["VAR"]):
            return self.end(s, self.assigned(s, p + 1, "VAR"))
        if x == c["const"]:
            return self.end(s, self.assigned(s, p + 1, "ID"))
        if x == c["goto"]:
            return self.end(s, p + 2)
        if x == c["namespace"] and s[p + 1] != c["\\"]:
            p += 1
            if s[p] not in can["block"]:
                p = self.qualified(s, p)
            return p + 1 if s[p] in can["block"] else self.end(s, p)
        if x == c["use"]:
            p += 1
            if s[p] in (c["function"], c["const"]):
                p += 1
            while True:
                q = self.qualified(s, p)
                if s[q] == c["\\"] and s[q + 1] in can["uses"]:
                    p = q + 2
                else:
                    p = self.use_item(s, p)
                if s[p] != c[","]:
                    return self.end(s, p)
                p += 1
        q = self.attributes(s, p)
        y = q
        while s[y] in (c["abstract"], c["final"], c["readonly"]):
            y += 1
        if s[y] in (c["class"], c["interface"], c["trait"]) or (s[y] == c["enum"] and s[y + 1] in self.ids and s[y + 2] not in can["args"]):
            enum = s[y] == c["enum"]
            if s[y + 1] not in self.ids:
                raise Bad("class name")
            p = y + 2
            if enum and s[p] == c[":"]:
                p = self.type(s, p + 1)
            p = self.qualified(s, p + 1) if s[p] == c["extends"] and s[y] != c["interface"] else p
            return self.group(s, self.heritage(s, p), "class")
        if s[q] == c["function"]:
            r = q + 2 if s[q + 1] == c["&"] else q + 1
            if s[r] in self.ids:
                return self.group(s, self.returns(s, self.group(s, r + 1, "params")), "block")
        if x in self.ids and s[p + 1] == c[":"]:
            return p + 2
        return self.end(s, self.expression(s, p))


@lru_cache(maxsize=1)
def _php() -> _Php:
    return _Php()


def php(text: str) -> None:
    parser = _php()
    char, match = parser.c, _LEXER.match
    out: list[str] = []
    at, n = 0, len(text)
    inside, last, probe, fed, plain = False, "", PROBE, 0, Reduction(parser.g, "program")
    while at < n:
        if len(out) >= probe:
            plain.probe("".join(out[fed:]))
            fed = len(out)
            probe = 2 * fed
        if not inside:
            m = _OPEN.search(text, at)
            if m is None:
                out.append(char["HTML"])
                break
            if m.start() > at:
                out.append(char["HTML"])
            at = m.end()
            if m.group().endswith("="):
                out.append(char["echo"])
            inside, last = True, ""
            continue
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        if kind in ("q", "tag"):
            kind = "heredoc"
        at = m.end()
        if kind in ("blank", "lc", "bc"):
            continue
        if kind == "close":
            if last not in (";", "{", "}", ":", ""):
                out.append(char[";"])
            inside = False
            continue
        tok = m.group()
        if kind == "word":
            low = tok.lower()
            tok = low if low in _HARD and last not in ("->", "?->") and not (last == "::" and low != "class") else "ID"
        elif kind == "var":
            tok = "VAR"
        elif kind == "attr":
            tok = "#["
        elif kind == "cast":
            tok = "CAST"
        elif kind != "op":
            tok = "LIT"
        out.append(char[tok])
        last = tok
    if not _OPEN.search(text):
        raise Bad("no program")  # a text without a program is one block of output, not PHP that was meant
    plain.finish("".join(out[fed:]))
