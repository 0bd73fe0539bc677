"""Lexical tokens of a line of code or configuration, and their features.

A token is a part of a line that a credential could fill exactly: a word of a string literal or of
bare text, the password of an address, the value of a ``key=value`` part, a whole key block. Quotes,
scheme words, user names and the rest of an address are tokens of their own.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple


class Token(NamedTuple):
    start: int
    end: int
    text: str
    kind: str  # what the lexer took it for
    gap: str  # the characters between the token before and this one


_KEY_HEAD = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
# A key block, up to its last line, or, where that is missing, as far as there are runs of its characters.
PRIVATE_BLOCK = re.compile(rf"{_KEY_HEAD}(?:(?:(?!-----BEGIN).)*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:(?:\\\\?[nrt]|[\s\"'+,])*[A-Za-z0-9+/=]{{16,}})+)", re.S)
OTHER_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|$)")
_DATA = r"data:[\w.+/-]+;base64,[A-Za-z0-9+/=_-]*"
_LITERAL = re.compile(
    r"\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`"
    r"|(?P<tag></?[A-Za-z][\w.:-]*>)|(?P<bare>[^\s\"'`<>(){}\[\]|,]+)",
    re.S,
)
_BLOCKS = re.compile(rf"(?P<private>{PRIVATE_BLOCK.pattern})|(?P<public>{OTHER_BLOCK.pattern})|(?P<data>{_DATA})", re.S)
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)://")
_USERINFO = re.compile(r"([^\s:/@?#]*):([^\s/]+|[^\s@]+)@(?=[\w.\-\[])")
_ADDRESS_PART = re.compile(r"[^\s/?&=#:;]+")
_PAIR = re.compile(r"([A-Za-z_][\w .\-]*?)=([^;]*)(?:;|$)")
_SPACED_PAIR = re.compile(r"([A-Za-z_][\w.\-]*)=(\S+)")
_DEFAULTED = re.compile(r"\$\{([A-Za-z_][\w.]*):[=-]?([^{}]*)\}$")
_ASSIGNED = re.compile(r"(-{0,2}[A-Za-z_$@][\w.\-$]*)(=|:=|:)(?=\S)(?!//)(.+)$", re.S)
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):$")
_WORD = re.compile(r"\S+")
_QUOTE_OR_END = {q: re.compile(rf"\\.|{q}|\n", re.S) for q in "\"'"}
_LETTERS = frozenset(string.ascii_letters)
_SCHEME_CHARS = _LETTERS | frozenset(string.digits + "+.-")
_LINE_ENDS, _BLOCK_SIGNS = frozenset(("\n", "\r")), frozenset("|>")


def _scheme_in(text: str) -> bool:
    """Whether a scheme and ``://`` occur in a text; sought from the sign backwards, since forwards each letter would be tried."""
    at = text.find("://")
    while at >= 0:
        i = at
        while i and text[i - 1] in _SCHEME_CHARS:
            i -= 1
            if text[i] in _LETTERS:
                return True
        at = text.find("://", at + 3)
    return False


def _address(text: str, base: int, out: list[tuple[int, int, str]]) -> None:
    """The parts of an address: scheme, user, password, host, path parts."""
    m = _SCHEME.search(text)
    assert m
    out.append((base + m.start(1), base + m.end(1), "scheme"))
    at = m.end()
    u = _USERINFO.match(text, at)
    if u:
        if u.group(1):
            out.append((base + u.start(1), base + u.end(1), "user"))
        out.append((base + u.start(2), base + u.end(2), "urlpw"))
        at = u.end()
    for i, p in enumerate(_ADDRESS_PART.finditer(text, at)):
        out.append((base + p.start(), base + p.end(), "host" if i == 0 else "path"))


def _inside(text: str, base: int, quoted: str, out: list[tuple[int, int, str]], value: bool = False) -> None:
    """The parts of a literal (``quoted``) or bare word that starts at ``base``; a bare ``value`` follows a name and a sign."""
    if not text:
        return
    d = _DEFAULTED.match(text)
    if d:
        out.append((base + d.start(1), base + d.end(1), "name"))
        if d.group(2):
            _inside(d.group(2), base + d.start(2), "default", out)
        return
    if "://" in text and _scheme_in(text):
        first = _WORD.search(text)
        if first and first.end() == len(text) and _SCHEME.match(text):
            _address(text, base, out)
        else:
            for w in _WORD.finditer(text):
                word = w.group()
                if _SCHEME.match(word):
                    _address(word, base + w.start(), out)
                else:
                    _bare(word, base + w.start(), quoted, out)
        return
    if quoted != "bare":
        if text.count(";") and text.count("=") >= 2 and _PAIR.match(text):
            for m in _PAIR.finditer(text):
                out.append((base + m.start(1), base + m.end(1), "pairkey"))
                if m.group(2):
                    out.append((base + m.start(2), base + m.end(2), "pairval"))
            return
        words = list(_WORD.finditer(text))
        if len(words) > 1:
            pairs = [_SPACED_PAIR.fullmatch(w.group()) for w in words]
            if sum(p is not None for p in pairs) >= 2:
                for w, p in zip(words, pairs, strict=True):
                    if p:
                        out.append((base + w.start() + p.start(1), base + w.start() + p.end(1), "pairkey"))
                        out.append((base + w.start() + p.start(2), base + w.start() + p.end(2), "pairval"))
                    else:
                        out.append((base + w.start(), base + w.end(), "word"))
                return
            headed = _HEADER.match(words[0].group()) is not None
            for i, w in enumerate(words):
                end = w.end() - 1 if i == 0 and headed else w.end()
                out.append((base + w.start(), base + end, "header" if i == 0 and headed else "word"))
            return
        if words:
            out.append((base + words[0].start(), base + words[0].end(), quoted))
        return
    _bare(text, base, quoted, out, value)


def _bare(text: str, base: int, quoted: str, out: list[tuple[int, int, str]], value: bool = False) -> None:
    """An unquoted word: an option, ``key=value``, ``user:value`` or a single part; as a ``value`` it isn't split at signs."""
    if ";" in text.rstrip(";") and "=" in text:
        at = 0
        for part in text.split(";"):
            _bare(part, base + at, quoted, out)
            at += len(part) + 1
        return
    end = len(text)
    while end and text[end - 1] in ";,":
        end -= 1
    text = text[:end]
    if not text:
        return
    if text.startswith("-p") and not text.startswith("--") and len(text) > 3 and not text.startswith("-p="):
        out.append((base, base + 2, "option"))
        out.append((base + 2, base + end, "optval"))
        return
    m = None if value else _ASSIGNED.match(text)
    if m and m.group(3).strip("=") and (m.group(2) != ":" or "=" not in m.group(1)):
        out.append((base + m.start(1), base + m.end(1), "pairkey"))
        _inside(m.group(3), base + m.start(3), "assigned", out)
        return
    bare = text if value else text.rstrip(":")
    out.append((base, base + (len(bare) or end), "bare"))


def _openable(line: str) -> str:
    """``line`` with a bar for each escaped quote behind the last that could close it, which opens nothing; each would be sought to the end."""
    for q in "\"'":
        if "\\" + q not in line:
            continue
        last, out, at = -1, [], 0
        for m in _QUOTE_OR_END[q].finditer(line + "\n"):
            if m.group() == q:
                last = m.start()
            elif m.group() == "\n":
                out += [line[at : last + 1], line[max(at, last + 1) : m.start()].replace(q, "|"), "\n"]
                at, last = m.end(), m.end() - 1
        out.append(line[at:])
        line = "".join(out)[: len(line)]
    return line


def _lexemes(line: str, base: int) -> Iterator[tuple[int, str, str]]:
    """The lexemes of a part of a line that has no block."""
    how = "bare"
    for m in _LITERAL.finditer(_openable(line) if "\\" in line else line):
        kind = m.lastgroup
        start, end = m.span(kind)
        if start == end:
            how = "value" if line[m.end() : m.end() + 1] == ":" else "bare"
            continue
        text = line[start:end]
        if kind == "bare":
            if line[end : end + 1] in _LINE_ENDS and (text == "\\" or (text[0] in "+-0123456789" and line[start - 1 : start] in _BLOCK_SIGNS)):
                continue
            yield base + start, text, how
            how = "value" if text[-1] in ":=" else "bare"
        elif kind == "tag":
            yield base + start, text, kind
            how = "value"
        else:
            yield base + start, text, "literal"
            how = "value" if line[m.end() : m.end() + 1] == ":" else "bare"


def lexemes(line: str) -> Iterator[tuple[int, str, str]]:
    """``start, text, how to split it`` of the tags, literals (without quotes), bare words and blocks of a line; empty literals are left out.

    A bare word is a ``value`` behind a name and a sign, and isn't split at signs.
    """
    at = 0
    if "-----BEGIN" in line or ";base64," in line:
        for m in _BLOCKS.finditer(line):
            yield from _lexemes(line[at : m.start()], at)
            yield m.start(), m.group(), m.lastgroup or "data"
            at = m.end()
    yield from _lexemes(line[at:] if at else line, at)


def parts(text: str, how: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the tokens of a lexeme."""
    out: list[tuple[int, int, str]] = []
    if how in ("bare", "value"):
        _inside(text, 0, "bare", out, how == "value")
    elif how == "literal":
        _inside(text, 0, "literal", out)
    else:
        out.append((0, len(text), how))
    return out


def tokens(line: str) -> list[Token]:
    """The tokens of ``line`` in order; empty literals give none."""
    out, at = [], 0
    for base, text, how in lexemes(line):
        for a, b, kind in parts(text, how):
            out.append(Token(base + a, base + b, text[a:b], kind, line[at : base + a]))
            at = base + b
    return out


# Words that name what grants access, as parts of a name, in several languages.
CREDENTIAL_WORDS = ("password", "passwd", "passphrase", "passwort", "kennwort", "contrasena", "secret", "token", "pwd", "pass", "pw", "passcode", "credential", "credentials", "apikey", "clave", "passe", "senha", "wachtwoord", "haslo", "parola", "salasana", "bearer")
# Words that make a credential of a following "key".
KEY_WORDS = ("api", "access", "private", "secret", "signing", "encryption", "auth", "service", "account", "master", "shared", "license")
# Words behind which a credential word is no longer the value itself.
OTHER_ENDS = ("label", "help", "error", "name", "hint", "hash", "id", "url", "file", "path", "check", "field", "count", "ttl", "header", "expiry", "expires", "type", "length", "policy", "regex", "pattern", "title", "text", "link", "reset", "list", "message", "placeholder", "public", "param")
# Names of connection strings and of headers.
CARRIERS = ("url", "uri", "dsn", "conn", "connection", "broker", "target", "hdr", "header", "session", "authorization", "auth", "hook", "webhook", "pem", "basic", "login", "identified", "database")
# Names of digests, ids and public parts.
DIGESTS = ("checksum", "hash", "digest", "integrity", "etag", "commit", "sha", "uuid", "id", "cert", "certificate", "public", "icon", "image", "logo", "fingerprint", "trace", "request", "build", "tenant", "docs", "revision", "version", "nonce", "etags")

# Words before "pass" that leave it a password, not a ticket or a step.
OWNERS = ("db", "database", "user", "admin", "root", "mail", "email", "smtp", "imap", "ftp", "sftp", "ssh", "app", "service", "svc", "account", "login", "api", "client", "server", "mysql", "pg", "postgres", "redis", "mq", "amqp", "ldap", "proxy", "wifi", "http", "basic", "test", "prod", "stage", "dev", "export", "legacy", "partner", "cache", "report", "backup", "master", "key", "keystore", "sudo", "vpn", "broker", "my", "the")

PART_END = re.compile(r"(\}[)\]]*)\s*,|(;)")
_OVER_LINES = re.compile(r"(?:\\|[|>][+-]?\d?[+-]?)?[ \t]*\r?\n")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
_CRED, _KEYW, _ENDS, _CARRY, _DIG, _OWN = map(frozenset, (CREDENTIAL_WORDS, KEY_WORDS, OTHER_ENDS, CARRIERS, DIGESTS, OWNERS))
_PLACEHOLDER = re.compile(r"^(?:<.*>|\{\{.*|.*\}\}|\$\{?[A-Za-z_].*|\$\(.*|%\(?[A-Za-z_]+\)?s?%?|env:.*|vault:.*|[*xX.\-_•]+|(?:your|my|insert|replace|change|set|todo|fixme|dummy|example|sample|placeholder|none|null|nil|undefined|true|false|test|redacted|masked|hidden|secret|password|token)(?:[_\- ]?(?:me|this|it|in|ci|here|your|key|token|password|secret|api|value|env|the|now))*|__.*__)$", re.I)
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_JWT = re.compile(r"^eyJ[\w-]+\.[\w-]+\.?[\w-]*$")
_PREFIXED = re.compile(r"^(?:[a-z]{2,6}[_-](?:(?:live|test|pat|prod)[_-])?[A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{12,}|[A-Z]{2,4}\.[A-Za-z0-9_.-]{16,})$")
_ISSUED = re.compile(r"^(?:(?:sk_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|npm_|pypi-|hf_|SG\.)[A-Za-z0-9_.-]{16,}|AKIA[A-Z0-9]{16})$")
_SHA = re.compile(r"^sha\d+[-:]", re.I)
_WORDS = re.compile(r"^[a-z]+(?:[-_.][a-z]+){2,}$")
_WORDNUM = re.compile(r"^[A-Za-z]+(?:[^\w\s][A-Za-z]+|_[A-Za-z]+)?\d{2,6}$")


@lru_cache(maxsize=1 << 15)
def name_class(text: str) -> tuple[str, str]:
    """What a name names: (class, last word)."""
    w = [x.lower() for x in _SPLIT.findall(text)]
    while w and w[-1].isdigit():
        w.pop()
    if not w or len(text) > 60:
        return "none", ""
    last, pair = w[-1], "_".join(w[-2:])
    if last == "pass" and len(w) > 1 and w[-2] not in _OWN:
        return "otherpass", last
    if last in _CRED or pair in ("api_key", "apikey_", "mot_passe") or (last == "key" and len(w) > 1 and w[-2] in _KEYW) or (last == "api" and len(w) > 1 and w[-2] in _CRED):
        return "cred", last
    if any(x in _CRED for x in w) and last in _ENDS:
        return "credother", last
    if last in _DIG or any(x in ("public", "docs") for x in w):
        return "digest", last
    if last in _CARRY or (len(w) > 1 and pair in ("hook_url", "primary_url")):
        return "carrier", last
    if any(x in _CRED for x in w):
        return "credpart", last
    if last == "key":
        return "key", last
    return "other", ""


@lru_cache(maxsize=1 << 15)
def value_class(text: str) -> tuple[str, ...]:
    """What a text looks like: its main class and finer signs."""
    n = len(text)
    if _PLACEHOLDER.match(text) or len(set(text)) <= 2:
        main = "placeholder"
    elif text.startswith("-----BEGIN"):
        main = "private" if PRIVATE_BLOCK.fullmatch(text) else "public"
    elif text.startswith("data:"):
        main = "data"
    elif _UUID.match(text):
        main = "uuid"
    elif _JWT.match(text):
        main = "jwt"
    elif _SHA.match(text):
        main = "sha"
    elif text.isdigit():
        main = "number"
    elif n >= 16 and all(c in "0123456789abcdefABCDEF" for c in text):
        main = "hex"
    elif _ISSUED.match(text) and any(c.isdigit() for c in text):
        main = "issued"
    elif _PREFIXED.match(text) and any(c.isdigit() or c.isupper() for c in text):
        main = "prefixed"
    elif _WORDS.match(text):
        main = "words"
    elif _WORDNUM.match(text):
        main = "wordnum"
    elif text.isalpha() and (text.islower() or text.isupper() or text.istitle()):
        main = "word"
    elif re.fullmatch(r"[A-Za-z_$][\w$]*", text) and ("_" in text or not any(c.isdigit() for c in text)) and _entropy(text) < 3.6:
        main = "name"
    elif re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", text) and not re.search(r"\d[a-zA-Z]\w*\d|[A-Z]\d|\d[A-Z]", text):
        main = "dotted"
    elif n >= 8 and _entropy(text) > 2.7 and sum((any(c.islower() for c in text), any(c.isupper() for c in text), any(c.isdigit() for c in text), any(not c.isalnum() for c in text))) >= 2:
        main = "mixed"
    else:
        main = "misc"
    return main, f"n{min(n // 4, 12)}", f"h{int(_entropy(text) * 2)}"


def _entropy(text: str) -> float:
    n = len(text)
    if not n:
        return 0.0
    chars = set(text)
    if len(chars) == n:
        return math.log2(n)
    return math.log2(n) - sum(v * math.log2(v) for v in map(text.count, chars)) / n


@lru_cache(maxsize=1 << 14)
def gap_class(gap: str) -> str:
    """The punctuation between two tokens, without blanks' number; a line end that a backslash or a block sign leads over is a blank."""
    if "\n" in gap:
        gap = _OVER_LINES.sub(" ", gap)
    return re.sub(r"\s+", " ", gap)[-6:]


def features(toks: list[Token], tail: str) -> list[list[str]]:
    """The features of each token: its own looks, its neighbours and the nearest names on both sides.

    ``tail``: what follows the last token.
    """
    return [[f for key in keys for f in expanded(key)] for keys in feature_keys(toks, tail)]


def expanded(key: tuple) -> list[str]:
    """The features that a key of ``feature_keys`` stands for."""
    what, *x = key
    if what == "own":
        kind, (v, vn, vh), nm, left, right, word, line = x
        return ["b", "k=" + kind, "v=" + v, "vn=" + v + vn, "vh=" + v + vh, "n=" + nm, "kv=" + kind + v, "l=" + left, "lv=" + left + v, "lk=" + left + kind, "lkv=" + left + kind + v, "r=" + right, "lrv=" + left + right + v, "line=" + line + kind, "lw=" + word + v]
    if what == "gap":
        gap, kind, behind = x
        return ["g=" + gap, "gk=" + gap + kind, "gn=" + behind]
    if what == "before":
        nm, before, kind, v, gap = x
        return ["p=" + nm + kind, "pv=" + nm + v, "pk=" + before + kind, "pg=" + nm + gap + v]
    return [what + "=" + "".join(x)]


def feature_keys(toks: list[Token], tail: str) -> Iterator[list[tuple]]:
    """The features of each token in groups, as keys that come again often (``expanded`` names their features).

    Neighbours and names are those of the same part of the line, up to a semicolon or a closed object behind a token, so that a
    token has the same features whether its part stands in a line of its own or in a long one.
    """
    start, first = 0, toks[0].gap if toks else ""
    for i in range(1, len(toks)):
        gap = toks[i].gap
        if (";" in gap or "}" in gap) and not toks[i].kind.startswith("pair"):
            m = PART_END.search(gap)
            if m:
                yield from _part_keys(toks[start:i], first, gap[: m.end(m.lastindex)])
                start, first = i, gap[m.end() :].lstrip(" ,;")
    if toks:
        yield from _part_keys(toks[start:], first, tail)


def _part_keys(toks: list[Token], first: str, tail: str) -> Iterator[list[tuple]]:
    """The keys of a part's tokens; ``first`` stands before the first one, ``tail`` behind the last."""
    names = [name_class(t.text) if t.kind not in ("urlpw", "path", "host", "private", "public", "data") and len(t.text) <= 60 else ("none", "") for t in toks]
    values = [value_class(t.text) if len(t.text) <= 500 else value_class.__wrapped__(t.text) for t in toks]
    gaps = [gap_class(first), *(gap_class(t.gap) for t in toks[1:])]
    n = len(toks)
    left, seen = ["^"] * n, "^"
    left_word = [""] * n
    word = ""
    for i in range(n):
        left[i], left_word[i] = seen, word
        if names[i][0] not in ("none", "other"):
            seen, word = names[i]
    right, seen = ["$"] * n, "$"
    for i in range(n - 1, -1, -1):
        right[i] = seen
        if names[i][0] not in ("none", "other"):
            seen = names[i][0]
    kinds = {t.kind for t in toks}
    line = "url" if "scheme" in kinds else "pairs" if "pairval" in kinds else "plain"
    words = [t.text[:12].lower()[:12] for t in toks]
    for i, t in enumerate(toks):
        kind, value, gap, v = t.kind, values[i], gaps[i], values[i][0]
        keys = [("own", kind, value, names[i][0], left[i], right[i], left_word[i], line), ("gap", gap, kind, gaps[i + 1] if i + 1 < n else tail[:3] + "$")]
        if i:
            keys += [("before", names[i - 1][0], toks[i - 1].kind, kind, v, gap), ("pw", words[i - 1])]
        else:
            keys.append(("first", v))
        if i > 1:
            keys += [("q", names[i - 2][0], v), ("qw", words[i - 2])]
        if i + 1 < n:
            keys += [("x", names[i + 1][0], v), ("xw", words[i + 1])]
        else:
            keys.append(("last", v))
        yield keys
