"""Shell scripts, as bash reads them."""

from __future__ import annotations

import re

from lodesift.llm.grammars.engine import Bad

_BLANKS = re.compile(r"(?:[ \t]|\\\n)+")
_OPERATOR = re.compile(r"&&|\|\||;;&|;&|;;|\|&|&>>|&>|<<<|<<-|<<|>>|>&|<&|>\||<>|[;&|<>()\n]")
_PLAIN = re.compile(r"[^\s\\'\"`$;&|<>()]+")
_FUNCTION_NAME = re.compile(r"[^\s;&|<>()$'\"`={}]+$")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
_BLANK_STARTS, _REDIRECT_STARTS = frozenset(" \t\\#"), frozenset("<>&{0123456789")
_IN_QUOTES = re.compile(r"[^\\\"$`]+")
_DESCRIPTOR = re.compile(r"(?:\d+|\{[A-Za-z_]\w*\})(?=[<>])")
_REDIRECTS = ("<", ">", ">>", "<<", "<<-", "<<<", ">&", "<&", ">|", "<>", "&>", "&>>")
_RESERVED = frozenset("if then elif else fi for while until do done case esac in function select time { } ! [[".split())
_CLOSERS = frozenset("then elif else fi do done esac }".split())


class _Shell:
    """A recursive-descent parser over the text itself: what a word is depends on where it stands."""

    def __init__(self, text: str):
        self.s, self.n, self.p = text, len(text), 0
        self.heredocs: list[tuple[str, bool]] = []

    # words

    def blanks(self) -> None:
        if self.s[self.p : self.p + 1] not in _BLANK_STARTS:
            return
        m = _BLANKS.match(self.s, self.p)
        if m:
            self.p = m.end()
        if self.p < self.n and self.s[self.p] == "#" and (self.p == 0 or self.s[self.p - 1] in " \t\n;&|()"):
            end = self.s.find("\n", self.p)
            self.p = self.n if end < 0 else end

    def newline(self) -> None:
        """Behind a line end: here-documents that are due are read."""
        self.p += 1
        for word, tabs in self.heredocs:
            while True:
                if self.p >= self.n:
                    self.heredocs = []
                    return  # bash only warns
                end = self.s.find("\n", self.p)
                end = self.n if end < 0 else end
                line = self.s[self.p : end]
                self.p = min(self.n, end + 1)
                if (line.lstrip("\t") if tabs else line) == word:
                    break
        self.heredocs = []

    def newlines(self) -> None:
        while True:
            self.blanks()
            if self.p < self.n and self.s[self.p] == "\n":
                self.newline()
            else:
                return

    def operator(self) -> str:
        """The operator at hand, not consumed; the empty text at the end."""
        self.blanks()
        m = _OPERATOR.match(self.s, self.p)
        return m.group() if m else ""

    def quoted(self) -> None:
        """A double-quoted text from behind its first quote."""
        s = self.s
        while self.p < self.n:
            c = s[self.p]
            if c == "\\":
                self.p += 2
            elif c == '"':
                self.p += 1
                return
            elif c == "$":
                self.dollar()
            elif c == "`":
                self.backquoted()
            else:
                self.p = _IN_QUOTES.match(s, self.p).end()  # type: ignore[union-attr]
        raise Bad("quote")

    def backquoted(self) -> None:
        end = self.p + 1
        while end < self.n and self.s[end] != "`":
            end += 2 if self.s[end] == "\\" else 1
        if end >= self.n:
            raise Bad("backquote")
        self.p = end + 1  # what it holds is read when the script runs

    def dollar(self) -> None:
        s = self.s
        if s.startswith("$((", self.p):
            at = self.p
            self.p += 3
            if self.arithmetic("))"):
                return
            self.p = at
        if s.startswith("$(", self.p):
            self.p += 2
            self.list((")",))
            self.expect(")")
        elif s.startswith("${", self.p):
            self.p += 2
            self.parameter()
        elif s.startswith("$'", self.p):
            self.p += 2
            while self.p < self.n and s[self.p] != "'":
                self.p += 2 if s[self.p] == "\\" else 1
            if self.p >= self.n:
                raise Bad("quote")
            self.p += 1
        elif s.startswith('$"', self.p):
            self.p += 2
            self.quoted()
        else:
            self.p += 1

    def parameter(self) -> None:
        """``${...}`` from behind its brace."""
        start = self.p
        while self.p < self.n:
            c = self.s[self.p]
            if c == "}":
                if self.p == start:
                    raise Bad("parameter")
                self.p += 1
                return
            if c == "\\":
                self.p += 2
            elif c == "'":
                end = self.s.find("'", self.p + 1)
                self.p = end + 1 if end >= 0 else self.p + 1
            elif c == '"':
                self.p += 1
                self.quoted()
            elif c == "$":
                self.dollar()
            elif c == "`":
                self.backquoted()
            else:
                self.p += 1
        raise Bad("parameter")

    def arithmetic(self, closing: str) -> bool:
        """Reads to ``closing`` with parentheses in pairs; False if there is none."""
        depth = 0
        while self.p < self.n:
            c = self.s[self.p]
            if depth == 0 and self.s.startswith(closing, self.p):
                self.p += len(closing)
                return True
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth < 0:
                    return False
            if c == "$":
                self.dollar()
            elif c == '"':
                self.p += 1
                self.quoted()
            else:
                self.p += 1
        return False

    def word(self) -> str:
        """A word, consumed; the empty text if none starts here."""
        self.blanks()
        s, start = self.s, self.p
        while self.p < self.n:
            c = s[self.p]
            m = _PLAIN.match(s, self.p)
            if m:
                self.p = m.end()
                if self.p < self.n and s[self.p] == "(":
                    before = s[start : self.p]
                    if _ASSIGNMENT.fullmatch(before):
                        self.array()
                    elif before[-1:] in "?*+@!" and len(before) >= 1:
                        self.p += 1
                        if not self.arithmetic(")"):
                            raise Bad("pattern")
            elif c == "\\":
                self.p += 2
            elif c == "'":
                end = s.find("'", self.p + 1)
                if end < 0:
                    raise Bad("quote")
                self.p = end + 1
            elif c == '"':
                self.p += 1
                self.quoted()
            elif c == "`":
                self.backquoted()
            elif c == "$":
                self.dollar()
            elif c in "<>" and s.startswith("(", self.p + 1):
                self.p += 2
                self.list((")",))
                self.expect(")")
            else:
                break
        if self.p > self.n:
            raise Bad("escape")
        return s[start : self.p]

    def array(self) -> None:
        self.p += 1
        while True:
            self.newlines()
            if self.s.startswith(")", self.p):
                self.p += 1
                return
            if not self.word():
                raise Bad("array")

    def peek(self) -> str:
        """The word at hand if it can be a reserved one, not consumed."""
        self.blanks()
        m = _PLAIN.match(self.s, self.p)
        w = m.group() if m else ""
        if w in _RESERVED and (m.end() >= self.n or self.s[m.end()] in " \t\n;&|()<>"):  # type: ignore[union-attr]
            return w
        return ""

    def expect(self, token: str) -> None:
        self.blanks()
        if token.isalpha() or token in ("{", "}"):
            if self.peek() != token:
                raise Bad(token)
        elif not self.s.startswith(token, self.p):
            raise Bad(token)
        self.p += len(token)

    # commands

    def redirect(self) -> bool:
        """A redirection, consumed."""
        self.blanks()
        if self.s[self.p : self.p + 1] not in _REDIRECT_STARTS:
            return False
        m = _DESCRIPTOR.match(self.s, self.p)
        at = m.end() if m else self.p
        op = _OPERATOR.match(self.s, at)
        if not op or op.group() not in _REDIRECTS or (self.s.startswith("(", at + 1) and op.group() in ("<", ">")):
            return False
        self.p = op.end()
        w = self.word()
        if not w:
            raise Bad("redirection")
        if op.group() in ("<<", "<<-"):
            self.heredocs.append((re.sub(r"['\"\\]", "", w), op.group() == "<<-"))
        return True

    def script(self) -> None:
        self.newlines()
        while self.p < self.n:
            self.list(())
            self.newlines()

    def list(self, ends: tuple[str, ...]) -> int:
        """Commands up to a closing word or one of ``ends``; there must be one."""
        count = 0
        while True:
            self.newlines()
            if self.p >= self.n or self.peek() in _CLOSERS or self.operator() in (*ends, ";;", ";&", ";;&"):
                if self.p < self.n and not ends and self.peek() in _CLOSERS and count == 0:
                    raise Bad("closing word")
                break
            self.pipeline()
            count += 1
            op = self.operator()
            if op in (";", "&"):
                self.p += len(op)
            elif op == "\n":
                self.newline()
            elif op in ("&&", "||"):
                self.p += 2
                self.newlines()
                if self.p >= self.n or self.peek() in _CLOSERS:
                    raise Bad("list")
            elif op == "" and self.p < self.n:
                raise Bad("separator")
            elif op not in ("", *ends, ";;", ";&", ";;&"):
                raise Bad(op)
        if count == 0 and ends != (")",):
            if ends or self.p < self.n:
                raise Bad("empty list")
        return count

    def some(self) -> None:
        if self.list(("\0",)) == 0:
            raise Bad("empty list")

    def pipeline(self) -> None:
        while self.peek() in ("!", "time"):
            self.p += len(self.peek())
        while True:
            self.command()
            op = self.operator()
            if op not in ("|", "|&"):
                return
            self.p += len(op)
            self.newlines()

    def command(self) -> None:
        w = self.peek()
        if w in _CLOSERS or w == "in":
            raise Bad(w)
        if w in ("if", "while", "until", "for", "select", "case", "{", "[[", "function"):
            self.p += len(w)
            getattr(self, {"{": "brace", "[[": "test", "if": "if_", "while": "while_", "until": "while_", "for": "for_", "select": "for_", "case": "case_", "function": "function"}[w])()
            while self.redirect():
                pass
            return
        self.blanks()
        if self.s.startswith("((", self.p):
            at = self.p
            self.p += 2
            if self.arithmetic("))"):
                return
            self.p = at
        if self.s.startswith("(", self.p):
            self.p += 1
            if self.list((")",)) == 0:
                raise Bad("subshell")
            self.expect(")")
            while self.redirect():
                pass
            return
        count, first = 0, ""
        while True:
            if self.redirect():
                count += 1
                continue
            x = self.word()
            if not x:
                break
            if count == 0:
                first = x
            count += 1
            if count == 1 and self.s.startswith("(", self.p) or (count == 1 and self.operator() == "("):
                self.expect("(")
                self.expect(")")
                if not _FUNCTION_NAME.match(first):
                    raise Bad("function name")
                self.newlines()
                self.body()
                return
        if count == 0:
            raise Bad("command")
        if self.operator() == "(":
            raise Bad("parenthesis")

    def body(self) -> None:
        """The compound command of a function."""
        if self.peek() not in ("{", "if", "while", "until", "for", "case", "[[", "select") and not self.s.startswith("(", self.p):
            raise Bad("function")
        self.command()

    def function(self) -> None:
        if not self.word():
            raise Bad("function")
        if self.operator() == "(":
            self.p += 1
            self.expect(")")
        self.newlines()
        self.body()

    def brace(self) -> None:
        self.some()
        self.expect("}")

    def if_(self) -> None:
        self.some()
        self.expect("then")
        self.some()
        while self.peek() == "elif":
            self.p += 4
            self.some()
            self.expect("then")
            self.some()
        if self.peek() == "else":
            self.p += 4
            self.some()
        self.expect("fi")

    def loop(self) -> None:
        self.expect("do")
        self.some()
        self.expect("done")

    def while_(self) -> None:
        self.some()
        self.loop()

    def for_(self) -> None:
        self.blanks()
        if self.s.startswith("((", self.p):
            self.p += 2
            if not self.arithmetic("))"):
                raise Bad("for")
            if self.operator() == ";":
                self.p += 1
        else:
            if not self.word():
                raise Bad("for")
            self.newlines()
            if self.peek() == "in":
                self.p += 2
                while self.operator() not in (";", "\n"):
                    if not self.word():
                        raise Bad("for")
            if self.operator() == ";":
                self.p += 1
        self.newlines()
        if self.peek() == "{":
            self.p += 1
            self.brace()
        else:
            self.loop()

    def case_(self) -> None:
        if not self.word():
            raise Bad("case")
        self.newlines()
        self.expect("in")
        while True:
            self.newlines()
            if self.peek() == "esac":
                self.p += 4
                return
            if self.operator() == "(":
                self.p += 1
            while True:
                if not self.word():
                    raise Bad("pattern")
                if self.operator() != "|":
                    break
                self.p += 1
            self.expect(")")
            self.newlines()
            if self.peek() != "esac" and self.operator() not in (";;", ";&", ";;&"):
                self.list(("\0",))
            op = self.operator()
            if op in (";;", ";&", ";;&"):
                self.p += len(op)
            elif self.peek() != "esac":
                raise Bad("case")

    def test(self) -> None:
        """``[[ ... ]]`` from behind its brackets."""
        count = 0
        while True:
            self.newlines()
            if self.s.startswith("]]", self.p):
                if not count:
                    raise Bad("test")
                self.p += 2
                return
            op = self.operator()
            if op in ("&&", "||", "(", ")", "<", ">"):
                self.p += len(op)
            elif not op and self.p < self.n:
                at = self.p
                w = self.word()
                if w == "=~":
                    self.blanks()
                    m = re.compile(r"(?:\\.|\"[^\"]*\"|'[^']*'|\([^\n]*?\)|\$\{[^}]*\}|[^\s\\\"'])+").match(self.s, self.p)
                    if not m:
                        raise Bad("pattern")
                    self.p = m.end()
                elif self.p == at:
                    raise Bad("test")
            elif op == "|":
                self.p += 1
            else:
                raise Bad("test")
            count += 1


def shell(text: str) -> None:
    s = _Shell(text)
    s.script()
