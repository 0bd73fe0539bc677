"""Java."""

from __future__ import annotations

import re
from functools import lru_cache

from lodesift.llm.grammars.engine import AT_ONCE, Bad, END, Flat, Grammar, PROBE, Reduction, Tokens, flat_pattern, mark_angles, operators, token_pattern

_PRIMITIVES = "boolean byte char double float int long short void".split()
_MODIFIERS = "abstract final native private protected public static strictfp synchronized transient volatile default".split()
_WORDS = [*_PRIMITIVES, *_MODIFIERS, *"assert break case catch class continue do else enum extends finally for if implements import instanceof interface new package return super switch this throw throws try while true false null".split()]
_SOFT = "var record yield sealed permits when non".split()
_HARD = frozenset(_WORDS) | frozenset(_SOFT)
_OPS = "{ } ( ) [ ] ; , . ... @ :: = < > ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<=".split()
_PARTS = {
    "word": r"[^\W\d][\w$]*+|\$[\w$]*+",
    "num": r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?!\w)",
    "text": r'"""[ \t\f]*\n(?:[^\\]|\\.)*?"""',
    "str": r"\"(?:[^\"\\\n]|\\.)*\"",
    "chr": r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'",
    "op": operators(_OPS),
}
_SKIP = r"(?:[\s\x1a]++|//[^\n]*|/\*.*?\*/)*+"
_LEXER = token_pattern(_PARTS, re.S, _SKIP)
_FLAT = flat_pattern(_PARTS, 0, _SKIP)
_SIGNS = frozenset(_OPS)


class _Java(Flat):
    def __init__(self) -> None:
        g = Grammar(
            ["ID", "LIT", *_WORDS, *_SOFT, *_OPS, "T<", "T>"],
            {
                "brace": ["block", "class", "enumbody", "switch", "init", "annotationbody"],
                "paren": ["expr", "args", "params", "forhead", "cast", "catch", "resources", "annotation", "lambda"],
                "square": ["index", "dims"],
                "angle": ["targs", "tparams"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square", "T< T>": "angle"},
        )
        super().__init__(g)
        self.ids = g.set("ID " + " ".join(_SOFT))
        self.primitives = g.set(" ".join(_PRIMITIVES))
        self.modifiers = g.set(" ".join(_MODIFIERS)) | g.set("sealed")
        self.prefix = g.set("+ - ! ~ ++ --")
        self.binary = g.set("= < == <= != && || + - * / & | ^ % << += -= *= /= &= |= ^= %= <<= >=")
        self.literals = g.set("LIT true false null this super")
        t = g.tests
        t["block"] = self.whole(self.run_of(self.statement))
        t["class"] = self.whole(self.run_of(self.member))
        t["enumbody"] = self.whole(self.enum_body)
        t["switch"] = self.whole(self.cases)
        t["init"] = self.whole(self.listed(self.initializer))
        t["annotationbody"] = t["class"]
        t["expr"] = t["index"] = self.whole(self.expression)
        t["args"] = self.whole(self.listed(self.expression, trailing=False))
        t["params"] = self.whole(self.listed(self.param, trailing=False))
        t["forhead"] = self.whole(self.for_head)
        t["cast"] = self.whole(self.cast)
        t["catch"] = self.whole(self.caught)
        t["resources"] = self.whole(self.listed(self.resource, comma=";"))
        t["annotation"] = self.whole(self.listed(self.annotation_value))
        t["lambda"] = self.whole(self.listed(self.lambda_param, trailing=False))
        t["dims"] = self.whole(lambda s, p: p)
        t["targs"] = self.whole(self.listed(self.type_argument, trailing=False))
        t["tparams"] = self.whole(self.listed(self.type_param, trailing=False, empty=False))

    # types

    def name(self, s: str, p: int) -> int:
        if s[p] not in self.ids:
            raise Bad("name")
        p += 1
        while s[p] == self.c["."] and s[p + 1] in self.ids:
            p += 2
        return p

    def annotations(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == c["@"] and s[p + 1] != c["interface"]:
            p = self.name(s, p + 1)
            if s[p] in self.can["annotation"]:
                p += 1
        return p

    def mods(self, s: str, p: int) -> int:
        c = self.c
        while True:
            q = self.annotations(s, p)
            if s[q] in self.modifiers and not (s[q] == c["default"] and s[q + 1] in (c[":"], c["->"])) and not (s[q] == c["sealed"] and s[q + 1] not in self.modifiers and s[q + 1] not in (c["class"], c["interface"])):
                q += 1
            elif s[q] == c["non"] and s[q + 1] == c["-"]:
                q += 3
            if q == p:
                return p
            p = q

    def type(self, s: str, p: int) -> int:
        c = self.c
        p = self.annotations(s, p)
        if s[p] in self.primitives:
            p += 1
        else:
            if s[p] not in self.ids:
                raise Bad("type")
            p += 1
            while True:
                if s[p] in self.can["targs"]:
                    p += 1
                elif s[p] == c["."] and s[p + 1] in self.ids:
                    p += 2
                else:
                    break
        return self.dims(s, p)

    def dims(self, s: str, p: int) -> int:
        while s[p] in self.can["dims"]:
            p += 1
        return p

    def type_argument(self, s: str, p: int) -> int:
        c = self.c
        p = self.annotations(s, p)
        if s[p] == c["?"]:
            p += 1
            return self.type(s, p + 1) if s[p] in (c["extends"], c["super"]) else p
        return self.type(s, p)

    def type_param(self, s: str, p: int) -> int:
        p = self.annotations(s, p)
        if s[p] not in self.ids:
            raise Bad("type parameter")
        p += 1
        if s[p] == self.c["extends"]:
            p = self.type(s, p + 1)
            while s[p] == self.c["&"]:
                p = self.type(s, p + 1)
        return p

    def cast(self, s: str, p: int) -> int:
        p = self.type(s, p)
        while s[p] == self.c["&"]:
            p = self.type(s, p + 1)
        return p

    # expressions

    def expression(self, s: str, p: int) -> int:
        c = self.c
        p = self.unit(s, p)
        while True:
            x = s[p]
            if x in self.binary:
                p = self.unit(s, p + 1)
            elif x == c[">"]:
                while s[p] == c[">"]:
                    p += 1
                if s[p] in (c["="], c[">="]):
                    p += 1
                p = self.unit(s, p)
            elif x == c["instanceof"]:
                p += 1
                if s[p] == c["final"]:
                    p += 1
                p = self.pattern(s, p)
            elif x == c["?"]:
                p = self.need(s, self.expression(s, p + 1), ":")
                p = self.expression(s, p)
            else:
                return p

    def pattern(self, s: str, p: int) -> int:
        p = self.type(s, p)
        if s[p] in self.can["params"] or s[p] in self.can["args"]:
            p += 1
        elif s[p] in self.ids and s[p] != self.c["when"]:
            p += 1
        return p

    def lambda_param(self, s: str, p: int) -> int:
        if s[p] not in self.ids:
            raise Bad("lambda")
        return p + 1

    def unit(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        while True:
            x = s[p]
            if x in self.prefix:
                p += 1
            elif x in can["cast"] and self.starts_operand(s[p + 1], x in can["expr"]):
                p += 1
            else:
                break
        x = s[p]
        if (x in self.ids and s[p + 1] == c["->"]) or ((x in can["lambda"] or x in can["params"]) and s[p + 1] == c["->"]):
            p += 2
            return p + 1 if s[p] in can["block"] else self.expression(s, p)
        if x == c["new"]:
            p = self.creation(s, p + 1)
        elif x == c["switch"]:
            p = self.group(s, self.group(s, p + 1, "expr"), "switch")
        elif x in self.literals or x in can["expr"]:
            p += 1
        elif x in self.ids or x in self.primitives:
            q = self.attempt(self.type, s, p)
            if q >= 0 and (s[q] == c["::"] or (s[q] == c["."] and s[q + 1] == c["class"])):
                p = q
            elif x in self.ids:
                p += 1
            else:
                raise Bad("type")
        else:
            raise Bad("operand")
        while True:
            x = s[p]
            if x == c["."]:
                p += 1
                if s[p] in can["targs"]:
                    p += 1
                if s[p] == c["new"]:
                    p = self.creation(s, p + 1)
                elif s[p] in self.ids or s[p] in (c["class"], c["this"], c["super"]):
                    p += 1
                else:
                    raise Bad("member")
            elif x == c["::"]:
                p += 1
                if s[p] in can["targs"]:
                    p += 1
                if s[p] not in self.ids and s[p] != c["new"]:
                    raise Bad("reference")
                p += 1
            elif x in can["args"] or x in can["index"]:
                p += 1
            elif x in (c["++"], c["--"]):
                p += 1
            else:
                return p

    def starts_operand(self, x: str, also_value: bool) -> bool:
        c = self.c
        if x in self.ids or x in self.literals or x in self.primitives or x in self.can["expr"] or x in self.can["lambda"] or x in (c["new"], c["switch"], c["!"], c["~"]):
            return True
        return not also_value and x in (c["+"], c["-"], c["++"], c["--"])

    def creation(self, s: str, p: int) -> int:
        if s[p] in self.can["targs"]:
            p += 1
        p = self.annotations(s, p)
        if s[p] in self.primitives:
            p += 1
        else:
            p = self.name(s, p)
            while s[p] in self.can["targs"] or (s[p] == self.c["."] and s[p + 1] in self.ids):
                p += 1 if s[p] in self.can["targs"] else 2
        if s[p] in self.can["args"]:
            p += 1
            return p + 1 if s[p] in self.can["class"] else p
        if s[p] in self.can["dims"]:
            return self.group(s, self.dims(s, p), "init")
        p = self.group(s, p, "index")
        while s[p] in self.can["index"] or s[p] in self.can["dims"]:
            p += 1
        return p

    def initializer(self, s: str, p: int) -> int:
        return p + 1 if s[p] in self.can["init"] else self.expression(s, p)

    # declarations

    def annotation_value(self, s: str, p: int) -> int:
        c = self.c
        if s[p] in self.ids and s[p + 1] == c["="]:
            p += 2
        if s[p] == c["@"]:
            return self.annotations(s, p)
        return self.initializer(s, p)

    def param(self, s: str, p: int) -> int:
        c = self.c
        p = self.type(s, self.mods(s, p))
        p = self.annotations(s, p)
        if s[p] == c["..."]:
            p += 1
        if s[p] == c["this"]:
            return p + 1
        if s[p] not in self.ids:
            raise Bad("parameter")
        return self.dims(s, p + 1)

    def caught(self, s: str, p: int) -> int:
        p = self.type(s, self.mods(s, p))
        while s[p] == self.c["|"]:
            p = self.type(s, p + 1)
        if s[p] not in self.ids:
            raise Bad("catch")
        return p + 1

    def resource(self, s: str, p: int) -> int:
        q = self.attempt(self.local, s, p)
        return q if q >= 0 and s[q] in (END, self.c[";"]) else self.expression(s, p)

    def declarators(self, s: str, p: int) -> int:
        c = self.c
        while True:
            if s[p] not in self.ids:
                raise Bad("declarator")
            p = self.dims(s, p + 1)
            if s[p] == c["="]:
                p = self.initializer(s, p + 1)
            if s[p] != c[","]:
                return p
            p += 1

    def local(self, s: str, p: int) -> int:
        return self.declarators(s, self.type(s, self.mods(s, p)))

    def type_declaration(self, s: str, p: int) -> int:
        """The place behind a class, interface, enum, record or annotation without modifiers, or -1."""
        c = self.c
        x = s[p]
        if x == c["@"] and s[p + 1] == c["interface"]:
            return self.group(s, p + 3, "class")
        if x not in (c["class"], c["interface"], c["enum"]) and not (x == c["record"] and s[p + 1] in self.ids and (s[p + 2] in self.can["params"] or s[p + 2] in self.can["tparams"])):
            return -1
        if s[p + 1] not in self.ids:
            raise Bad("class name")
        p += 2
        if s[p] in self.can["tparams"]:
            p += 1
        if x == c["record"]:
            p = self.group(s, p, "params")
        for word in ("extends", "implements", "permits"):
            if s[p] == c[word]:
                p = self.type(s, p + 1)
                while s[p] == c[","]:
                    p = self.type(s, p + 1)
        return self.group(s, p, "enumbody" if x == c["enum"] else "class")

    def enum_body(self, s: str, p: int) -> int:
        c = self.c
        while s[p] != END and s[p] != c[";"]:
            p = self.annotations(s, p)
            if s[p] not in self.ids:
                raise Bad("constant")
            p += 1
            if s[p] in self.can["args"]:
                p += 1
            if s[p] in self.can["class"]:
                p += 1
            if s[p] == c[","]:
                p += 1
            elif s[p] not in (END, c[";"]):
                raise Bad("constant")
        while s[p] != END:
            p = self.member(s, p)
        return p

    def member(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        if s[p] == c[";"]:
            return p + 1
        if s[p] in can["block"]:
            return p + 1
        if s[p] == c["static"] and s[p + 1] in can["block"]:
            return p + 2
        p = self.mods(s, p)
        q = self.type_declaration(s, p)
        if q >= 0:
            return q
        if s[p] in can["tparams"]:
            p += 1
        if s[p] in self.ids and (s[p + 1] in can["params"] or s[p + 1] in can["block"]):
            p += 1
            p = self.throws(s, p + 1 if s[p] in can["params"] else p)
            return self.group(s, p, "block")
        p = self.type(s, p)
        if s[p] in self.ids and s[p + 1] in can["params"]:
            p = self.throws(s, self.dims(s, p + 2))
            if s[p] == c["default"]:
                p = self.annotation_value(s, p + 1)
            return p + 1 if s[p] in can["block"] else self.need(s, p, ";")
        return self.need(s, self.declarators(s, p), ";")

    def throws(self, s: str, p: int) -> int:
        if s[p] == self.c["throws"]:
            p = self.type(s, p + 1)
            while s[p] == self.c[","]:
                p = self.type(s, p + 1)
        return p

    # statements

    def for_head(self, s: str, p: int) -> int:
        c = self.c
        q = self.attempt(self.type, s, self.mods(s, p))
        if q >= 0 and s[q] in self.ids and s[q + 1] == c[":"]:
            return self.expression(s, q + 2)
        listed = self.listed(self.expression, trailing=False, empty=False)
        if s[p] != c[";"]:
            q = self.attempt(self.local, s, p)
            p = q if q >= 0 and s[q] == c[";"] else listed(s, p)
        p = self.need(s, p, ";")
        if s[p] != c[";"]:
            p = self.expression(s, p)
        p = self.need(s, p, ";")
        return p if s[p] == END else listed(s, p)

    def cases(self, s: str, p: int) -> int:
        c = self.c
        while s[p] != END:
            if s[p] == c["case"]:
                p += 1
                while True:
                    if s[p] == c["default"]:
                        p += 1
                    else:
                        q = self.attempt(self.ternary_free, s, p)
                        r = self.attempt(self.pattern, s, p)
                        p = max(q, r)
                        if p < 0:
                            raise Bad("case")
                    if s[p] == c["when"]:
                        p = self.expression(s, p + 1)
                    if s[p] != c[","]:
                        break
                    p += 1
            elif s[p] == c["default"]:
                p += 1
            else:
                raise Bad("case")
            if s[p] == c["->"]:
                p = self.statement(s, p + 1)
                continue
            p = self.need(s, p, ":")
            while s[p] not in (END, c["case"], c["default"]):
                p = self.statement(s, p)
        return p

    def ternary_free(self, s: str, p: int) -> int:
        if s[p] in self.ids and s[p + 1] == self.c["->"]:
            return p + 1
        if s[p] in self.can["expr"] and s[p + 1] == self.c["->"]:
            return p + 1
        return self.expression(s, p)

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
        if x == c["while"]:
            return self.statement(s, self.group(s, p + 1, "expr"))
        if x == c["do"]:
            p = self.need(s, self.statement(s, p + 1), "while")
            return self.need(s, self.group(s, p, "expr"), ";")
        if x == c["switch"]:
            q = self.group(s, self.group(s, p + 1, "expr"), "switch")
            if s[q] != c["."]:
                return q
        if x == c["try"]:
            p += 1
            some = s[p] in can["resources"]
            p = self.group(s, p + 1 if some else p, "block")
            while s[p] == c["catch"]:
                p = self.group(s, self.group(s, p + 1, "catch"), "block")
                some = True
            if s[p] == c["finally"]:
                return self.group(s, p + 1, "block")
            if not some:
                raise Bad("try")
            return p
        if x == c["return"]:
            return p + 2 if s[p + 1] == c[";"] else self.need(s, self.expression(s, p + 1), ";")
        if x in (c["throw"], c["yield"]) and s[p + 1] not in (c["="], c["."]) and s[p + 1] not in self.can["args"]:
            return self.need(s, self.expression(s, p + 1), ";")
        if x == c["throw"]:
            return self.need(s, self.expression(s, p + 1), ";")
        if x in (c["break"], c["continue"]):
            p += 1
            return self.need(s, p + 1 if s[p] in self.ids else p, ";")
        if x == c["assert"]:
            p = self.expression(s, p + 1)
            return self.need(s, self.expression(s, p + 1) if s[p] == c[":"] else p, ";")
        if x == c["synchronized"] and s[p + 1] in can["expr"]:
            return self.group(s, p + 2, "block")
        if x in self.ids and s[p + 1] == c[":"]:
            return self.statement(s, p + 2)
        q = self.mods(s, p)
        r = self.type_declaration(s, q)
        if r >= 0:
            return r
        r = self.attempt(self.local, s, p)
        if r >= 0 and s[r] == c[";"]:
            return r + 1
        return self.need(s, self.expression(s, p), ";")

    def unit_of_code(self, s: str, p: int) -> int:
        c = self.c
        q = self.annotations(s, p)
        if s[q] == c["package"]:
            p = self.need(s, self.name(s, q + 1), ";")
        while s[p] in (c["import"], c[";"]):
            if s[p] == c[";"]:
                p += 1
                continue
            p += 2 if s[p + 1] == c["static"] else 1
            p = self.name(s, p)
            if s[p] == c["."]:
                p = self.need(s, p + 1, "*")
            p = self.need(s, p, ";")
        while s[p] != END:
            if s[p] == c[";"]:
                p += 1
                continue
            p = self.type_declaration(s, self.mods(s, p))
            if p < 0:
                raise Bad("type")
        return p


@lru_cache(maxsize=1)
def _java() -> tuple:
    j = _Java()
    j.g.tests["program"] = j.whole(j.unit_of_code)
    c = j.c
    inside = frozenset(c[t] for t in ["ID", *_SOFT, *_PRIMITIVES, ",", ".", "?", "extends", "super", "&", "@"])
    after = frozenset(c[t] for t in ["ID", *_SOFT, "(", ")", "[", "]", "{", "}", ",", ";", ".", "::", ">", "...", "&", "?", ":", "=", "&&", "||", "implements", "extends", "@", *_PRIMITIVES, "this", "new", "->", "|", "==", "!="])
    return j, (c["<"], c[">"], (c["T<"], c["T>"]), inside, after, {c["["]: c["]"], c["("]: c[")"]})


def _named(text: str) -> str:
    """The name of a token by its text."""
    first = text[:1]
    if not text or text in _SIGNS or text in _HARD:
        return text
    if first in "\"'":
        return "LIT" if len(text) > 1 else "\x00"
    return "LIT" if first.isdigit() or (first == "." and len(text) > 1) else "ID" if first in "$_" or first.isalpha() or text.isidentifier() else "\x00"


@lru_cache(maxsize=1)
def _tokens() -> Tokens:
    return Tokens(_java()[0].c, _named)


def java(text: str) -> None:
    j, angles = _java()
    char, match = j.c, _LEXER.match
    out: list[str] = []
    at, n, probe, fed, plain = 0, len(text), PROBE, 0, Reduction(j.g, "program")
    while at < n:
        if len(out) >= probe:
            new = "".join(out[fed:])
            plain.probe(new.split(char["<"], 1)[0])  # what an angle means is only known later
            if fed == 0 and at < n - AT_ONCE:  # it may be a program: the whole text is lexed at once
                s = _tokens().read(_FLAT.findall(text))
                if "\x00" in s:
                    raise Bad("character")
                if char["<"] in s:
                    out = list(s)
                    mark_angles(out, *angles)
                    s = "".join(out)
                j.g.run(s, "program")
                return
            fed = len(out)
            probe = 2 * fed if char["<"] not in new else n + 1
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "end":
            break
        tok = text[start:at]
        if kind == "word":
            tok = tok if tok in _HARD else "ID"
        elif kind != "op":
            tok = "LIT"
        out.append(char[tok])
    if char["<"] in out:
        mark_angles(out, *angles)
        j.g.run("".join(out), "program")
    else:
        plain.finish("".join(out[fed:]))
