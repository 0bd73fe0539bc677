"""The supported languages by name."""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Callable

from lodesift.llm.grammars import clang, golang, java, javascript, php, ruby, shell, yamlish
from lodesift.llm.grammars.engine import Bad
from lodesift.operators.shred import read


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # the language's own parser refuses nesting beyond its stack
            raise Bad(str(e)) from None


def _json(text: str) -> None:
    try:
        read(text, constants=False)
    except ValueError as e:
        raise Bad(str(e)) from None


PARSERS: dict[str, Callable[[str], None]] = {
    "python": _python,
    "javascript": javascript.javascript,
    "typescript": javascript.typescript,
    "go": golang.go,
    "java": java.java,
    "php": php.php,
    "ruby": ruby.ruby,
    "c": clang.c,
    "shell": shell.shell,
    "json": _json,
    "yaml": yamlish.yaml,
}
LANGUAGES = tuple(PARSERS)
#: Frames of the parsers written here, which recurse on the heap; chains of ``else if`` and the like may be as long as memory allows.
DEEPEST = 10_000_000


def parses(text: str, language: str) -> bool:
    """Whether ``text`` is a program of ``language``: line ends are read as LF, a byte order mark is skipped."""
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
        sys.set_int_max_str_digits(0)
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    try:
        PARSERS[language](text)
    except Bad:
        return False
    return True
