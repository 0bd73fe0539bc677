"""Catalogs of taint sources, sinks and sanitizers: a built-in core, and a loader for larger ones.

A full catalog of thousands of entries is a parameter (a JSON file of the same fields), not code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Source:
    id: str
    category: str
    language: str
    pattern: str


@dataclass(frozen=True)
class Sink:
    id: str
    category: str
    language: str
    pattern: str
    args: tuple[int, ...] = (0,)
    severity: int = 3
    cwe: str = ""


@dataclass(frozen=True)
class Sanitizer:
    id: str
    language: str
    pattern: str
    neutralizes: tuple[str, ...]


# Sources, as language, category, id, pattern.
_SOURCES = (
    ("python", "user_input", "py.request.args", r"request\.args"),
    ("python", "user_input", "py.request.form", r"request\.form"),
    ("python", "user_input", "py.request.data", r"request\.data"),
    ("python", "user_input", "py.request.json", r"request\.json\b|request\.get_json\("),
    ("python", "user_input", "py.request.values", r"request\.values"),
    ("python", "user_input", "py.request.headers", r"request\.headers"),
    ("python", "user_input", "py.request.cookies", r"request\.cookies"),
    ("python", "user_input", "py.request.get", r"request\.GET"),
    ("python", "user_input", "py.request.post", r"request\.POST"),
    ("python", "user_input", "py.input", r"input\("),
    ("python", "cli_arg", "py.sys.argv", r"sys\.argv"),
    ("python", "env_var", "py.os.environ", r"os\.environ\[?|os\.getenv\("),
    ("python", "network", "py.socket.recv", r"\.recv\("),
    ("python", "file_read", "py.open.read", r"open\(.*\)\.read\("),
    ("python", "deserialized", "py.json.loads", r"json\.loads\(|json\.load\("),
    ("javascript", "user_input", "js.req.query", r"req\.query"),
    ("javascript", "user_input", "js.req.body", r"req\.body"),
    ("javascript", "user_input", "js.req.params", r"req\.params"),
    ("javascript", "user_input", "js.req.headers", r"req\.headers"),
    ("javascript", "user_input", "js.req.cookies", r"req\.cookies"),
    ("javascript", "user_input", "js.location", r"window\.location|document\.location|location\.(?:hash|search|href)"),
    ("javascript", "cli_arg", "js.argv", r"process\.argv"),
    ("javascript", "env_var", "js.env", r"process\.env"),
    ("go", "user_input", "go.formvalue", r"\.FormValue\("),
    ("go", "user_input", "go.query", r"\.URL\.Query\(\)"),
    ("go", "user_input", "go.body", r"r\.Body|req\.Body"),
    ("go", "user_input", "go.header", r"\.Header\.Get\("),
    ("go", "cli_arg", "go.args", r"os\.Args"),
    ("go", "env_var", "go.getenv", r"os\.Getenv\("),
    ("java", "user_input", "java.parameter", r"\.getParameter\("),
    ("java", "user_input", "java.header", r"\.getHeader\("),
    ("java", "user_input", "java.cookies", r"\.getCookies\("),
    ("java", "env_var", "java.getenv", r"System\.getenv\("),
    ("php", "user_input", "php.get", r"\$_GET"),
    ("php", "user_input", "php.post", r"\$_POST"),
    ("php", "user_input", "php.request", r"\$_REQUEST"),
    ("php", "user_input", "php.cookie", r"\$_COOKIE"),
    ("ruby", "user_input", "rb.params", r"params\["),
    ("ruby", "user_input", "rb.cookies", r"cookies\["),
    ("ruby", "env_var", "rb.env", r"ENV\["),
    ("c", "cli_arg", "c.argv", r"argv\["),
    ("c", "env_var", "c.getenv", r"getenv\("),
)
# Sinks, as language, category, id, pattern, dangerous arguments (-1 all), severity, weakness.
_SINKS = (
    ("python", "sql_query", "py.execute", r"\.execute\(|\.executemany\(", (0,), 4, "CWE-89"),
    ("python", "command_exec", "py.os.system", r"os\.system\(", (0,), 4, "CWE-78"),
    ("python", "command_exec", "py.os.popen", r"os\.popen\(", (0,), 4, "CWE-78"),
    ("python", "command_exec", "py.subprocess", r"subprocess\.(?:call|run|Popen|check_output|check_call)\(", (0,), 4, "CWE-78"),
    ("python", "code_eval", "py.eval", r"\beval\(", (0,), 4, "CWE-94"),
    ("python", "code_eval", "py.exec", r"\bexec\(", (0,), 4, "CWE-94"),
    ("python", "file_write", "py.open", r"\bopen\(", (0,), 3, "CWE-22"),
    ("python", "redirect", "py.redirect", r"redirect\(", (0,), 3, "CWE-601"),
    ("python", "template_render", "py.render_template_string", r"render_template_string\(", (0,), 4, "CWE-1336"),
    ("python", "deserialize", "py.pickle.loads", r"pickle\.loads?\(", (0,), 4, "CWE-502"),
    ("python", "url_fetch", "py.requests", r"requests\.(?:get|post|put|delete|patch)\(", (0,), 3, "CWE-918"),
    ("python", "log_output", "py.log", r"(?:logging|logger|log)\.(?:info|warning|error|debug)\(", (-1,), 2, "CWE-117"),
    ("javascript", "sql_query", "js.query", r"\.query\(|\.execute\(", (0,), 4, "CWE-89"),
    ("javascript", "command_exec", "js.exec", r"\bexec\(|\bexecSync\(|\bspawn\(", (0,), 4, "CWE-78"),
    ("javascript", "code_eval", "js.eval", r"\beval\(|new Function\(", (0,), 4, "CWE-94"),
    ("javascript", "html_output", "js.write", r"\.innerHTML\s*=|document\.write\(|res\.send\(", (-1,), 3, "CWE-79"),
    ("javascript", "file_write", "js.fs", r"fs\.(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream)\(", (0,), 3, "CWE-22"),
    ("javascript", "redirect", "js.redirect", r"res\.redirect\(", (0,), 3, "CWE-601"),
    ("javascript", "url_fetch", "js.fetch", r"\bfetch\(|axios\.(?:get|post)\(", (0,), 3, "CWE-918"),
    ("javascript", "log_output", "js.console", r"console\.(?:log|error|warn)\(", (-1,), 2, "CWE-117"),
    ("go", "sql_query", "go.query", r"\.(?:Query|QueryRow|Exec)\(", (0,), 4, "CWE-89"),
    ("go", "command_exec", "go.exec", r"exec\.Command\(", (-1,), 4, "CWE-78"),
    ("go", "html_output", "go.fprint", r"fmt\.Fprint(?:f|ln)?\(w", (-1,), 3, "CWE-79"),
    ("go", "file_write", "go.os.open", r"os\.(?:Open|Create|ReadFile|WriteFile|Remove)\(", (0,), 3, "CWE-22"),
    ("go", "redirect", "go.redirect", r"http\.Redirect\(", (2,), 3, "CWE-601"),
    ("go", "url_fetch", "go.http.get", r"http\.(?:Get|Post|Head)\(", (0,), 3, "CWE-918"),
    ("java", "sql_query", "java.execute", r"\.execute(?:Query|Update)?\(", (0,), 4, "CWE-89"),
    ("java", "command_exec", "java.exec", r"\.exec\(", (0,), 4, "CWE-78"),
    ("java", "log_output", "java.log", r"log(?:ger)?\.(?:info|warn|error|debug)\(", (-1,), 2, "CWE-117"),
    ("php", "sql_query", "php.query", r"->query\(|mysqli_query\(|->exec\(", (0,), 4, "CWE-89"),
    ("php", "command_exec", "php.exec", r"\b(?:system|exec|shell_exec|passthru|popen)\(", (0,), 4, "CWE-78"),
    ("php", "html_output", "php.echo", r"\becho\s|\bprint\s", (-1,), 3, "CWE-79"),
    ("php", "file_write", "php.file", r"file_(?:put|get)_contents\(|\bfopen\(", (0, 1), 3, "CWE-22"),
    ("ruby", "sql_query", "rb.execute", r"\.execute\(|\.find_by_sql\(", (0,), 4, "CWE-89"),
    ("ruby", "command_exec", "rb.system", r"\bsystem\(|\bexec\(|Open3\.", (0,), 4, "CWE-78"),
    ("ruby", "file_write", "rb.file", r"File\.(?:read|open|write)\(", (0,), 3, "CWE-22"),
    ("c", "command_exec", "c.system", r"\bsystem\(|\bpopen\(", (0,), 4, "CWE-78"),
)
# Sanitizers, as language, id, pattern, neutralised categories.
_SANITIZERS = (
    ("python", "py.html.escape", r"html\.escape\(|markupsafe\.escape\(|bleach\.clean\(", ("html_output",)),
    ("python", "py.int", r"\bint\(", ("sql_query", "command_exec")),
    ("python", "py.shlex.quote", r"shlex\.quote\(", ("command_exec",)),
    ("python", "py.basename", r"os\.path\.basename\(|secure_filename\(", ("file_write",)),
    ("javascript", "js.escape", r"escapeHtml\(|DOMPurify\.sanitize\(|encodeURIComponent\(", ("html_output", "redirect")),
    ("javascript", "js.int", r"parseInt\(|Number\(", ("sql_query", "command_exec")),
    ("javascript", "js.basename", r"path\.basename\(", ("file_write",)),
    ("go", "go.escape", r"html\.EscapeString\(|template\.HTMLEscapeString\(", ("html_output",)),
    ("go", "go.atoi", r"strconv\.(?:Atoi|ParseInt|ParseUint)\(", ("sql_query", "command_exec")),
    ("go", "go.clean", r"filepath\.(?:Clean|Base)\(", ("file_write",)),
    ("java", "java.parse", r"Integer\.parseInt\(|Long\.parseLong\(", ("sql_query", "command_exec")),
    ("php", "php.escape", r"htmlspecialchars\(|htmlentities\(", ("html_output",)),
    ("php", "php.int", r"\bintval\(|\(int\)", ("sql_query", "command_exec")),
    ("ruby", "rb.to_i", r"\.to_i\b", ("sql_query", "command_exec")),
    ("ruby", "rb.basename", r"File\.basename\(", ("file_write",)),
)


@dataclass(frozen=True)
class Catalog:
    sources: tuple[Source, ...]
    sinks: tuple[Sink, ...]
    sanitizers: tuple[Sanitizer, ...]

    def of(self, language: str) -> Catalog:
        """The entries of a language; TypeScript has JavaScript's too, C++ those of C."""
        also = {"typescript": "javascript", "cpp": "c"}.get(language, language)
        keep = lambda rows: tuple(r for r in rows if r.language in (language, also))
        return Catalog(keep(self.sources), keep(self.sinks), keep(self.sanitizers))


CORE = Catalog(
    tuple(Source(i, c, lang, p) for lang, c, i, p in _SOURCES),
    tuple(Sink(i, c, lang, p, args, sev, cwe) for lang, c, i, p, args, sev, cwe in _SINKS),
    tuple(Sanitizer(i, lang, p, n) for lang, i, p, n in _SANITIZERS),
)


def load(path: str | Path) -> Catalog:
    """A catalog from JSON: ``{"sources": [...], "sinks": [...], "sanitizers": [...]}`` with the fields above."""
    d = json.loads(Path(path).read_text(encoding="utf-8"))
    tupled = lambda e: {k: tuple(v) if isinstance(v, list) else v for k, v in e.items()}
    return Catalog(tuple(Source(**e) for e in d.get("sources", ())), tuple(Sink(**tupled(e)) for e in d.get("sinks", ())), tuple(Sanitizer(**tupled(e)) for e in d.get("sanitizers", ())))
