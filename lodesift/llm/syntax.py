"""Source files that do not parse in the language they are filed under.

Each file is ranked by its tokens and parsed by the grammars of all supported languages; what comes out is the list of the languages
that accept it, the likeliest first. Only that list is joined with the language the file is filed under: if this is among them, the file is valid;
if only others are, it has the wrong extension; if none is, it is corrupt. No text is moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import BLANKS, label
from lodesift.llm.grammars import LANGUAGES, parses
from lodesift.session import ship, spread

# Words and signs that speak for a language, for the ranking only.
SIGNS: dict[str, tuple[str, ...]] = {
    "python": ("def", "elif", "import", "from", "self", "None", "True", "except", "lambda", "with", "pass", "raise", "and", "not", "is"),
    "javascript": ("const", "let", "var", "function", "=>", "===", "async", "await", "require", "console", "typeof", "undefined", "null"),
    "typescript": ("interface", "export", "readonly", "private", "string", "number", "boolean", "=>", "const", "type", "implements", "Record"),
    "go": ("package", "func", ":=", "defer", "chan", "go", "nil", "range", "struct", "fmt", "err", "interface", "map"),
    "java": ("public", "private", "class", "void", "static", "final", "extends", "implements", "throws", "new", "package", "import", "String", "@Override"),
    "php": ("<?php", "$this", "->", "echo", "function", "foreach", "array", "=>", "namespace", "use", "::", "<?="),
    "ruby": ("def", "end", "do", "require", "module", "puts", "elsif", "unless", "nil", "attr_accessor", "@", "class", "each"),
    "c": ("#include", "#define", "int", "char", "void", "struct", "static", "return", "sizeof", "printf", "->", "typedef", "unsigned"),
    "shell": ("#!/bin/sh", "#!/bin/bash", "#!/usr/bin/env", "fi", "then", "done", "esac", "echo", "$1", "local", "set", "export", "do"),
    "json": ('{', '}', '":', 'true', 'false', 'null', '["', '",'),
    "yaml": ("---", ": ", "- ", "true", "false", "|", ">-"),
}
_TOKEN = re.compile(r"#include|#define|#!/[\w/]+|<\?php|<\?=|\$\w+|@\w*|\w+|=>|===|:=|->|::|\":|\",|\[\"|[{}|]|---|: |- |>-")


#: By sign, the languages it speaks for and how much one of it weighs.
_WEIGHTS = {sign: [(lang, 1 / len(signs)) for lang, signs in SIGNS.items() if sign in signs] for sign in {x for signs in SIGNS.values() for x in signs}}


def ranking(text: str) -> list[str]:
    """All languages, the likeliest first by the share of its signs among the text's tokens; ties in the order of ``LANGUAGES``."""
    score = dict.fromkeys(LANGUAGES, 0.0)
    for sign, n in Counter(filter(_WEIGHTS.__contains__, _TOKEN.findall(text))).items():
        for lang, weight in _WEIGHTS[sign]:
            score[lang] += n * weight
    return sorted(LANGUAGES, key=lambda lang: -score[lang])


def accepting(text: str) -> list[str]:
    """The languages that accept ``text``, the likeliest first; every grammar is tried."""
    return [lang for lang in ranking(text) if parses(text, lang)]


def parsed(files: DataFrame) -> DataFrame:
    """The other columns of ``files`` and ``accepted``, the languages that accept ``content``; a column of that name is replaced.

    Rows with null or blank content are left out. Line ends are read as LF, a byte order mark is no fault. Repeated rows are
    judged each; whole texts are parsed, by every grammar.
    """
    ship(files.sparkSession)
    keys = [c for c in files.columns if c not in ("content", "accepted")]
    rows = files.where(F.coalesce(F.trim("content", F.lit(BLANKS)) != "", F.lit(False))).select(*keys, "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([accepting(text) for text in batch.column(len(keys)).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*keys, "accepted"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", accepted array<string>")


def verdicts(judged: DataFrame) -> DataFrame:
    """``input_id, repo, lang, valid, parsed_as, verdict`` of each row of ``judged`` (``input_id, repo, lang, accepted``).

    ``verdict`` is ``valid``, ``wrong_extension`` or ``corrupt``; ``parsed_as`` is ``lang`` where that accepts the file, else the likeliest language that
    does. Rows of other languages than the supported ones and without language are left out; extra columns are ignored.
    """
    valid = F.array_contains("accepted", F.col("lang"))
    return judged.where(F.col("lang").isin(list(LANGUAGES))).select(
        "input_id",
        "repo",
        "lang",
        valid.alias("valid"),
        F.when(valid, F.col("lang")).otherwise(F.get("accepted", F.lit(0))).alias("parsed_as"),
        F.when(valid, "valid").when(F.size("accepted") > 0, "wrong_extension").otherwise("corrupt").alias("verdict"),
    )


def written_files(hook_inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``input_id, repo, lang, accepted`` of the files written whole; ``lang`` is the language the ledger names for their entry.

    An entry that the ledger holds twice gives a row each; files without entry are left out.
    """
    writes = hook_inputs.where(F.col("tool_name") == "Write").select("input_id", "entry_id", F.col("cwd").alias("repo"), F.col("tool_input.content").alias("content"))
    named = ledger.select("entry_id", label(F.col("lang")).alias("lang")).where(F.col("lang").isin(list(LANGUAGES)))
    return parsed(spread(writes.where(F.col("content").isNotNull() & F.col("entry_id").isNotNull()))).join(named, "entry_id").select("input_id", "repo", "lang", "accepted")


def report(judged: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones by kind, and the rate of invalid ones."""
    n = judged.groupBy("repo", "lang").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if(F.col("verdict") == "wrong_extension").alias("n_wrong_extension"),
        F.count_if(F.col("verdict") == "corrupt").alias("n_corrupt"),
    )
    return n.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
