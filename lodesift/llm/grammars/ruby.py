"""Ruby."""

from __future__ import annotations

import re
from functools import lru_cache

from lodesift.llm.grammars.engine import Bad, END, Flat, Grammar, PROBE, Reduction, operators, token_pattern

_OPENERS = "def class module begin if unless while until for case do".split()
_WORDS = [*_OPENERS, *"alias and break defined? else elsif end ensure false in next nil not or redo rescue retry return self super then true undef when yield __FILE__ __LINE__ __method__ BEGIN END".split()]
_HARD = frozenset(_WORDS)
_MODIFIERS = frozenset(["if", "unless", "while", "until", "rescue"])
_OPS = "{ } ( ) [ ] ; , . &. :: .. ... + - * / % ** = == === != =~ !~ <=> < > <= >= ! ~ & | ^ << >> && || += -= *= /= %= **= &= |= ^= <<= >>= &&= ||= ? : => ->".split()
_LEXER = token_pattern(
    {
        "nl": r"\n",
        "ivar": r"@@?[A-Za-z_\x80-\U0010ffff]\w*|\$(?:[A-Za-z_]\w*|\d+|-\w|[!@&`'+~=/\\,;.<>_*$?:\"])",
        "label": r"(?:[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*+[?!]?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'):(?![:\w])(?=\s|[,)\]}\"'])",
        "sym": r":(?:[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*[?!=]?(?![=~>])|[A-Za-z_]\w*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\[\]=?|\*\*|[+\-]@?|<=>|===?|=~|![=~]?|<<|>>|<=?|>=?|[*/%&|^~])",
        "word": r"(?:defined\?|[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*+(?:[?!](?![=~](?![=~>])))?)",
        "num": r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*(?!\w)",
        "chr": r"\?(?:\\.|[^\s\w]|\w(?!\w))(?=[\s,)\].;]|$)",
        "quote": r"['\"`]",
        "op": operators(_OPS),
    },
    re.S,
    r"(?:[ \t\r\f\v]|\\\n)*+(?:\#[^\n]*)?",
)
_SETTER = re.compile(r"=\s*\(|=[ \t]*\w+[ \t]*\n")
_TAGGED = re.compile(r"<<[~-]['\"]?[A-Z]")
_COMMENT_END = re.compile(r"^=end[^\n]*(?:\n|\Z)", re.M)
_DATA = re.compile(r"__END__(?:\n|\Z)")
_GOES_ON = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*(?:&?\.(?![.])\s*\w|&&|\|\|)")
_HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Za-z_]\w*)\2")
_PERCENT = re.compile(r"%([qQwWiIrsx]?)([^\w\s])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_VALUE_END = frozenset(["ID", "CONST", "LIT", "STR", "IVAR", ")", "]", "}", "end", "self", "nil", "true", "false", "super", "yield", "__FILE__", "__LINE__", "__method__", "redo", "retry", "break", "next", "return"])
_NO_END = frozenset(["=", "==", "===", "!=", "=~", "!~", "<=>", "<", ">", "<=", ">=", "!", "~", "&", "|", "^", "<<", ">>", "&&", "||", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", "&&=", "||=", "?", ":", "=>", "->", "+", "-", "*", "/", "%", "**", ",", ".", "&.", "::", "(", "[", "{", "NL", ";", "and", "or", "not", "|P", "LABEL", ""])


class _Ruby(Flat):
    def __init__(self) -> None:
        g = Grammar(
            ["ID", "CONST", "IVAR", "LIT", "STR", "LABEL", "NL", "mod", "loopdo", "|P", "T(", *_WORDS, *_OPS],
            {
                "brace": ["hash", "block"],
                "paren": ["args", "params", "stmts", "targets"],
                "square": ["list"],
                "def": ["defbody"],
                "class": ["classbody"],
                "module": ["modulebody"],
                "begin": ["beginbody"],
                "if": ["ifbody"],
                "loop": ["loopbody"],
                "for": ["forbody"],
                "case": ["casebody"],
                "do": ["doblock"],
            },
            {"{ }": "brace", "( )": "paren", "[ ]": "square", "def end": "def", "class end": "class", "module end": "module", "begin end": "begin", "if end": "if", "unless end": "if", "while end": "loop", "until end": "loop", "for end": "for", "case end": "case", "do end": "do"},
        )
        super().__init__(g)
        self.NL, self.SEMI = self.c["NL"], self.c[";"]
        self.ends = (self.NL, self.SEMI)
        self.prefix = g.set("+ - ! ~ & * ** ..  ... defined? ::")
        self.binary = g.set("+ - * / % ** = == === != =~ !~ <=> < > <= >= & | ^ << >> && || += -= *= /= %= **= &= |= ^= <<= >>= &&= ||= .. ...")
        self.operators_ = g.set("+ - * / % ** == === =~ <=> < > <= >= & | ^ << >> ! ~ != !~")
        self.atoms = g.set("ID CONST IVAR LIT STR self nil true false __FILE__ __LINE__ __method__ redo retry")
        self.names = g.set("ID CONST " + " ".join(_WORDS))
        for kind in ("defbody", "classbody", "modulebody", "beginbody", "ifbody", "loopbody", "forbody", "casebody"):
            g.tests[kind] = self.whole(getattr(self, kind))
        self.compound = frozenset().union(*(self.can[k] for k in ("defbody", "classbody", "modulebody", "beginbody", "ifbody", "loopbody", "forbody", "casebody")))
        t = g.tests
        t["hash"] = self.whole(self.listed(self.pair), "NL")
        t["block"] = t["doblock"] = self.whole(self.blockbody)
        t["args"] = self.whole(self.listed(self.argument), "NL")
        t["params"] = self.whole(self.listed(self.param), "NL")
        t["targets"] = self.whole(self.listed(self.target), "NL")
        t["stmts"] = self.whole(self.body)
        t["list"] = self.whole(self.listed(self.argument), "NL")
        t["program"] = self.whole(self.program)

    # statements

    def program(self, s: str, p: int) -> int:
        return self.statements(s, p, frozenset())

    def skip(self, s: str, p: int) -> int:
        while s[p] in self.ends:
            p += 1
        return p

    def statements(self, s: str, p: int, stops: frozenset[str]) -> int:
        while True:
            p = self.skip(s, p)
            if s[p] == END or s[p] in stops:
                return p
            p = self.statement(s, p)
            if s[p] != END and s[p] not in self.ends and s[p] not in stops:
                raise Bad("statement")

    def body(self, s: str, p: int) -> int:
        """Statements with ``rescue``, ``else`` and ``ensure`` parts."""
        c = self.c
        stops = frozenset((c["rescue"], c["else"], c["ensure"]))
        p = self.statements(s, p, stops)
        while s[p] == c["rescue"]:
            p += 1
            while s[p] not in (END, *self.ends, c["then"], c["=>"]):
                p = self.argument(s, p)
                if s[p] == c[","]:
                    p += 1
            if s[p] == c["=>"]:
                p = self.target(s, p + 1)
            if s[p] == c["then"]:
                p += 1
            elif s[p] not in self.ends and s[p] != END and s[p] not in stops:
                raise Bad("rescue")
            p = self.statements(s, p, stops)
        if s[p] == c["else"]:
            p = self.statements(s, p + 1, stops)
        if s[p] == c["ensure"]:
            p = self.statements(s, p + 1, stops)
        return p

    def statement(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["alias"]:
            for _ in range(2):
                p += 1
                if s[p] not in self.names and s[p] not in (c["LIT"], c["STR"], c["IVAR"]) and s[p] not in self.operators_:
                    raise Bad("alias")
            return p + 1
        if s[p] == c["undef"]:
            return p + 2
        if s[p] in (c["BEGIN"], c["END"]):
            return self.group(s, p + 1, "block")
        p = self.expression(s, p)
        while s[p] == c["mod"]:
            p = self.expression(s, p + 1)
        return p

    def expression(self, s: str, p: int) -> int:
        c = self.c
        while True:
            while s[p] == c["not"]:
                p += 1
            p = self.chain(s, p)
            if s[p] == c["=>"] or s[p] == c["in"]:
                p = self.pattern(s, p + 1)
            if s[p] not in (c["and"], c["or"]):
                return p
            p = self.skip(s, p + 1)

    def chain(self, s: str, p: int) -> int:
        """An operator expression, possibly a multiple assignment or with a ternary."""
        c = self.c
        p = self.unit(s, p)
        if s[p] == c[","]:
            q = self.attempt(self.multiple, s, p)
            if q >= 0:
                p = q
        while True:
            x = s[p]
            if x in self.binary:
                assign = x == c["="]
                if x in (c[".."], c["..."]) and (s[p + 1] in (END, *self.ends, c["then"])):
                    return p + 1
                p = self.unit(s, p + 1)
                if assign:
                    while s[p] == c[","]:
                        p = self.chain_unit(s, p + 1)
            elif x == c["?"]:
                p = self.chain(s, p + 1)
                if s[p] == c["LABEL"]:
                    raise Bad("ternary")
                p = self.chain(s, self.need(s, p, ":"))
            else:
                return p

    def chain_unit(self, s: str, p: int) -> int:
        p = self.unit(s, p)
        while s[p] in self.binary and s[p] != self.c["="]:
            p = self.unit(s, p + 1)
        return p

    def multiple(self, s: str, p: int) -> int:
        c = self.c
        while s[p] == c[","]:
            p += 1
            if s[p] == c["="]:
                break
            p = self.unit(s, p)
        if s[p] != c["="]:
            raise Bad("assignment")
        return p

    def command_start(self, s: str, p: int, spaced: bool) -> bool:
        """Whether an argument without parentheses starts here."""
        c, can = self.c, self.can
        x = s[p]
        return x in self.atoms or x in (c["LABEL"], c["->"], c["not"], c["defined?"], c["super"], c["yield"], c["!"]) or x in self.compound or (spaced and (x in can["list"] or x in can["args"]))

    def unit(self, s: str, p: int) -> int:
        c, can = self.c, self.can
        while s[p] in self.prefix:
            p += 1
        x = s[p]
        if x in (c["return"], c["break"], c["next"]):
            p += 1
            if s[p] in (END, *self.ends, c["mod"], c["and"], c["or"]) or s[p] in (c[":"], c["?"]):
                return p
            return self.arguments(s, p)
        if x in (c["yield"], c["super"]):
            p += 1
            if s[p] in can["args"]:
                p += 1
            elif self.command_start(s, p, False) or (s[p] in can["list"] and x == c["yield"]):
                return self.arguments(s, p)
        elif x == c["->"]:
            p += 1
            if s[p] in can["params"]:
                p += 1
            else:
                while s[p] not in can["block"] and s[p] not in can["doblock"] and s[p] != END:
                    p = self.param(s, p)
                    if s[p] == c[","]:
                        p += 1
            if s[p] not in can["block"] and s[p] not in can["doblock"]:
                raise Bad("lambda")
            p += 1
        elif x in (c["ID"], c["CONST"]):
            p += 1
            if s[p] in can["args"]:
                p += 1
            elif x == c["ID"] and self.command_start(s, p, False) or x == c["CONST"] and s[p] == c["STR"]:
                p = self.arguments(s, p)
            p = self.blocks(s, p)
        elif x == c["STR"]:
            p += 1
            while s[p] == c["STR"]:
                p += 1
        elif x in self.atoms or x in self.compound or x in can["list"] or x in can["hash"] or x in can["stmts"]:
            p += 1
        else:
            raise Bad("operand")
        while True:
            x = s[p]
            if x in (c["."], c["&."], c["::"]):
                p += 1
                if s[p] in can["args"]:
                    p += 1
                    continue
                if s[p] not in self.names and s[p] not in self.operators_ and s[p] != c["LABEL"]:
                    raise Bad("method")
                p += 1
                if s[p] in can["args"]:
                    p += 1
                elif self.command_start(s, p, False):
                    p = self.arguments(s, p)
                p = self.blocks(s, p)
            elif x in can["list"]:
                p += 1
            elif x in can["args"] and s[p - 1] in can["doblock"]:
                p += 1
            else:
                return p

    def blocks(self, s: str, p: int) -> int:
        return p + 1 if s[p] in self.can["block"] or s[p] in self.can["doblock"] else p

    def arguments(self, s: str, p: int) -> int:
        p = self.argument(s, p)
        while s[p] == self.c[","]:
            p = self.argument(s, self.skip(s, p + 1))
        return self.blocks(s, p)

    def argument(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["LABEL"]:
            p += 1
            if s[p] in (END, c[","]):
                return p
            return self.value(s, self.skip(s, p))
        if s[p] in (c["*"], c["**"], c["&"], c["..."]) and s[p + 1] in (END, c[","]):
            return p + 1
        p = self.value(s, p)
        return self.value(s, p + 1) if s[p] == c["=>"] else p

    def value(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["not"]:
            p += 1
        p = self.unit(s, p)
        while True:
            x = s[p]
            if x in self.binary:
                if x in (c[".."], c["..."]) and s[p + 1] in (END, c[","]):
                    return p + 1
                p = self.unit(s, p + 1)
            elif x == c["?"]:
                p = self.value(s, self.need(s, self.value(s, p + 1), ":"))
            else:
                return p

    def pair(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["LABEL"]:
            p = self.argument(s, p)
            return self.value(s, p + 1) if s[p] == c["=>"] else p
        if s[p] == c["**"]:
            return self.value(s, p + 1)
        return self.value(s, self.need(s, self.value(s, p), "=>"))

    def pattern(self, s: str, p: int) -> int:
        """A pattern of ``in`` or ``=>``: values, labels, alternatives."""
        c = self.c
        while True:
            if s[p] == c["LABEL"]:
                p += 1
                if s[p] in (END, *self.ends, c[","], c["then"], c["mod"]):
                    if s[p] != c[","]:
                        return p
                    p += 1
                    continue
            if s[p] in (c["*"], c["**"]) and s[p + 1] in (END, *self.ends, c[","], c["then"]):
                p += 1
            else:
                p = self.value(s, p)
            while s[p] == c["=>"]:
                p = self.value(s, p + 1)
            if s[p] != c[","]:
                return p
            p += 1

    # bodies of words

    def param(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["LABEL"]:
            p += 1
            return p if s[p] in (END, c[","], c["|"], *self.ends) else self.default(s, p)
        if s[p] in (c["*"], c["**"], c["&"], c["..."]):
            p += 1
            return p + 1 if s[p] in (c["ID"], c["nil"]) else p
        if s[p] in self.can["targets"]:
            return p + 1
        p = self.need(s, p, "ID")
        return self.default(s, p + 1) if s[p] == c["="] else p

    def default(self, s: str, p: int) -> int:
        p = self.unit(s, p)
        while s[p] in self.binary and s[p] != self.c["|"]:
            p = self.unit(s, p + 1)
        return p

    def target(self, s: str, p: int) -> int:
        if s[p] in (self.c["*"], self.c["**"], self.c["&"]):
            p += 1
            if s[p] in (END, self.c[","], self.c["|"]):
                return p
        return p + 1 if s[p] in self.can["targets"] and s[p] not in self.can["list"] else self.unit(s, p)

    def blockbody(self, s: str, p: int) -> int:
        c = self.c
        p = self.skip(s, p) if s[p] == self.NL and s[self.skip(s, p)] == c["|P"] else p
        if s[p] == c["|P"]:
            p += 1
            while s[p] != c["|P"]:
                if s[p] == self.SEMI:
                    p += 1
                p = self.param(s, p)
                if s[p] == c[","]:
                    p += 1
                elif s[p] not in (c["|P"], self.SEMI):
                    raise Bad("block parameter")
            p += 1
        elif s[p] == c["||"]:
            p += 1
        return self.body(s, p)

    def defbody(self, s: str, p: int) -> int:
        c = self.c
        if (s[p] in self.names or s[p] in self.can["stmts"]) and s[p + 1] == c["."]:
            p += 2
        if s[p] in self.operators_ or s[p] in self.can["list"]:
            p += 1
        elif s[p] in self.names or s[p] == c["LIT"]:
            p += 1
        else:
            raise Bad("method name")
        if s[p] == c["="] and s[p + 1] in self.can["params"]:
            p += 1
        if s[p] in self.can["params"]:
            p += 1
            if s[p] == c["="]:
                raise Bad("endless method")
        else:
            while s[p] != END and s[p] not in self.ends:
                p = self.param(s, p)
                if s[p] == c[","]:
                    p += 1
                elif s[p] != END and s[p] not in self.ends:
                    raise Bad("parameter")
        return self.body(s, p)

    def path(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["::"]:
            p += 1
        p = self.need(s, p, "CONST")
        while s[p] == c["::"]:
            p = self.need(s, p + 1, "CONST")
        return p

    def classbody(self, s: str, p: int) -> int:
        c = self.c
        if s[p] == c["<<"]:
            p = self.expression(s, p + 1)
        else:
            p = self.path(s, p)
            if s[p] == c["<"]:
                p = self.expression(s, p + 1)
        if s[p] != END and s[p] not in self.ends:
            raise Bad("class")
        return self.body(s, p)

    def modulebody(self, s: str, p: int) -> int:
        p = self.path(s, p)
        if s[p] != END and s[p] not in self.ends:
            raise Bad("module")
        return self.body(s, p)

    def beginbody(self, s: str, p: int) -> int:
        return self.body(s, p)

    def then(self, s: str, p: int) -> int:
        c = self.c
        q = self.skip(s, p)
        if s[q] == c["then"]:
            return q + 1
        if q == p:
            raise Bad("then")
        return q

    def ifbody(self, s: str, p: int) -> int:
        c = self.c
        stops = frozenset((c["elsif"], c["else"]))
        p = self.statements(s, self.then(s, self.statement(s, p)), stops)
        while s[p] == c["elsif"]:
            p = self.statements(s, self.then(s, self.statement(s, p + 1)), stops)
        return self.statements(s, p + 1, frozenset()) if s[p] == c["else"] else p

    def loopbody(self, s: str, p: int) -> int:
        p = self.statement(s, p)
        if s[p] == self.c["loopdo"]:
            p += 1
        elif s[p] not in self.ends:
            raise Bad("loop")
        return self.statements(s, p, frozenset())

    def forbody(self, s: str, p: int) -> int:
        c = self.c
        p = self.target(s, p)
        while s[p] == c[","]:
            p = self.target(s, p + 1)
        return self.loopbody(s, self.need(s, p, "in"))

    def casebody(self, s: str, p: int) -> int:
        c = self.c
        if s[p] not in self.ends:
            p = self.statement(s, p)
        p = self.skip(s, p)
        stops = frozenset((c["when"], c["in"], c["else"]))
        some = False
        while s[p] in (c["when"], c["in"]):
            some = True
            if s[p] == c["when"]:
                p = self.argument(s, p + 1)
                while s[p] == c[","]:
                    p = self.argument(s, self.skip(s, p + 1))
            else:
                p = self.pattern(s, p + 1)
                while s[p] == c["mod"]:
                    p = self.expression(s, p + 1)
            p = self.statements(s, self.then(s, p), stops)
        if not some:
            raise Bad("case")
        return self.statements(s, p + 1, frozenset()) if s[p] == c["else"] else p


@lru_cache(maxsize=1)
def _ruby() -> _Ruby:
    return _Ruby()


@lru_cache(maxsize=64)
def _plain(closing: str, opening: str) -> re.Pattern[str]:
    """A run of characters that neither end a literal, nest in it, escape nor embed."""
    return re.compile(f"[^\\\\#{re.escape(closing)}{re.escape(opening)}]*")


def _quoted(text: str, at: int, closing: str, opening: str, embeds: bool) -> int:
    """The end of a literal whose content starts at ``at``; what ``#{}`` embeds must parse."""
    n, depth = len(text), 0
    while at < n:
        ch = text[at]
        if ch == "\\":
            at += 2
        elif ch == closing and depth == 0:
            return at + 1
        elif opening and ch == opening:
            depth += 1
            at += 1
        elif opening and ch == closing:
            depth -= 1
            at += 1
        elif embeds and ch == "#" and text.startswith("{", at + 1):
            at = _lex(text, at + 2, True)
        else:
            at = _plain(closing, opening).match(text, at + 1).end()  # type: ignore[union-attr]
    raise Bad("literal")


def _lex(text: str, at: int, inner: bool) -> int:
    """Lexes and parses from ``at``: a whole program, or (``inner``) up to the brace that ends an embedded one."""
    parser = _ruby()
    char, match = parser.c, _LEXER.match
    out: list[str] = []
    heredocs: list[tuple[str, str]] = []
    loops: list[int] = []  # depths at which a loop waits for its ``do``
    depth, braces, n = 0, 0, len(text)
    last, blank, bars = "", True, 0
    block_open = False
    probe, fed, plain = n + 1 if inner else PROBE, 0, Reduction(parser.g, "program")
    while at < n:
        if len(out) >= probe:
            plain.probe("".join(out[fed:]))
            fed = len(out)
            probe = 2 * fed
        if at == 0 or text[at - 1] == "\n":
            if text.startswith("=begin", at):
                m = _COMMENT_END.search(text, at)
                if not m:
                    raise Bad("comment")
                at = m.end()
                continue
            if text.startswith("__END__", at) and _DATA.match(text, at):
                break
        m = match(text, at)
        if m is None:
            raise Bad("character")
        kind = m.lastgroup
        start, end = m.span(kind)
        blank, at = blank or start > at, start
        if kind == "end":
            break
        tok = text[start:end]
        value = last in _VALUE_END
        if kind == "nl":
            at = end
            for tag, dash in heredocs:
                while True:
                    if at >= n:
                        raise Bad("here-document")
                    stop = text.find("\n", at)
                    stop = n if stop < 0 else stop
                    line = text[at:stop]
                    at = min(n, stop + 1)
                    if (line.strip() if dash else line) == tag:
                        break
            heredocs = []
            blank = True
            # a line that starts with a dot goes on
            if last not in _NO_END and not _GOES_ON.match(text, at):
                while loops and loops[-1] == depth:
                    loops.pop()
                out.append(char["NL"])
                last = "NL"
            elif last in ("|P",):
                out.append(char["NL"])
            continue
        was_block, block_open = block_open, False
        if kind == "word":
            if last in (".", "&.") or (last == "def" and tok not in ("self",)):
                name = "CONST" if tok[0].isupper() and last != "def" else "ID"
                if last == "def":
                    name = "ID"
                    if text[end : end + 1] == "=" and _SETTER.match(text, end) and text[end + 1 : end + 2] not in ("=", "~"):
                        end += 1
                    if text[end : end + 1] == "." and tok[0].isupper():
                        name = "CONST"
                out.append(char[name])
                last, at, blank = "ID", end, False
                continue
            if tok in _HARD:
                if tok in _MODIFIERS and value or (tok == "rescue" and last not in ("NL", ";", "", "begin", "do", "{")):
                    out.append(char["mod"])
                    last, at, blank = "mod", end, False
                    continue
                if tok == "do" and loops and loops[-1] == depth:
                    loops.pop()
                    out.append(char["loopdo"])
                    last, at, blank = ";", end, False
                    continue
                if tok in ("while", "until", "for"):
                    loops.append(depth + 1)
                if tok in _OPENERS:
                    depth += 1
                    if tok == "do":
                        block_open = True
                elif tok == "end":
                    while loops and loops[-1] >= depth:
                        loops.pop()
                    depth -= 1
                out.append(char[tok])
                last = tok if tok in _VALUE_END or tok in ("def", "and", "or", "not", "rescue") else ";" if tok in ("else", "ensure", "begin", "do", "then") else ""
                at, blank = end, False
                continue
            tok = "CONST" if tok[0].isupper() else "ID"
        elif kind == "label":
            if last == "?" and tok[-1] == ":" and not text[end : end + 1].isspace():
                tok, end = ("CONST" if tok[0].isupper() else "ID"), end - 1
            elif last == "?" or (tok[0] in "\"'" and _ternary_open(out, char)):
                end -= 1
                tok = "STR" if tok[0] in "\"'" else "CONST" if tok[0].isupper() else "ID"
            else:
                tok = "LABEL"
        elif kind in ("sym", "num"):
            tok = "LIT"
            if kind == "sym" and value and not blank:
                raise Bad("symbol")
        elif kind == "chr":
            if value and not (blank and last == "ID"):
                tok, end = "?", at + 1
            else:
                tok = "LIT"
        elif kind == "ivar":
            tok = "IVAR"
        elif kind == "quote":
            end = _quoted(text, end, tok, "", tok != "'")
            tok = "LIT" if tok == "`" else "STR"
        else:
            if tok == "<<" and (not value or (blank and last == "ID" and not text[end : end + 1].isspace())):
                h = _HEREDOC.match(text, at)
                if h:
                    heredocs.append((h.group(3), h.group(1)))
                    tok, end = "LIT", h.end()
            elif tok in ("<<", "<<=") and value and _HEREDOC.match(text, at) and _TAGGED.match(text, at):
                h = _HEREDOC.match(text, at)
                heredocs.append((h.group(3), h.group(1)))  # type: ignore[union-attr]
                tok, end = "LIT", h.end()  # type: ignore[union-attr]
            elif tok in ("%", "%=") and (not value or (blank and last == "ID" and text[end : end + 1] not in (" ", "="))):
                h = _PERCENT.match(text, at)
                if not h:
                    raise Bad("literal")
                opening = h.group(2)
                end = _quoted(text, h.end(), _PAIRS.get(opening, opening), opening if opening in _PAIRS else "", h.group(1) not in ("q", "w", "i", "s"))
                if h.group(1) == "r":
                    while text[end : end + 1].isalpha():
                        end += 1
                tok = "LIT"
            elif tok in ("/", "/=") and (not value or (blank and last == "ID" and not text[at + 1 : at + 2].isspace() and text[at + 1 : at + 2] != "=")):
                end = _quoted(text, at + 1, "/", "", True)
                while text[end : end + 1].isalpha():
                    end += 1
                tok = "LIT"
            elif tok == "|" and (was_block or bars):
                tok = "|P"
                bars = 0 if bars else 1
            elif tok == "{":
                braces += 1
                depth += 1
                block_open = value or last in ("->",)
            elif tok == "}":
                if inner and braces == 0:
                    parser.g.run("".join(out), "program")
                    return end
                braces -= 1
                depth -= 1
            elif tok in ("(", "["):
                depth += 1
            elif tok in (")", "]"):
                depth -= 1
            elif tok == "?" and not value:
                raise Bad("character")
        out.append(char[tok])
        last = "LIT" if tok in ("LIT", "STR", "IVAR") else tok
        if last == "|P" and not bars:
            last = ";"
        at, blank = end, False
    if heredocs:
        raise Bad("here-document")
    if inner:
        raise Bad("literal")
    plain.finish("".join(out[fed:]))
    return at


def _ternary_open(out: list[str], char: dict[str, str]) -> bool:
    """Whether a ``?`` in the line at hand still waits for its colon."""
    opened = 0
    for c in reversed(out[-40:]):
        if c == char["NL"]:
            break
        opened += (c == char["?"]) - (c == char[":"])
    return opened > 0


def ruby(text: str) -> None:
    _lex(text, 0, False)
