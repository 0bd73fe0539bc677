"""Credentials written out in source text: exact places, and texts with only the values replaced.

Every statement (a line, with the lines it goes on over) is split into lexical tokens, however long it is; a
linear-chain conditional random field with shape and context features labels them, and the Viterbi path's ``S``
tokens are the characters to redact. Key blocks over several lines are one token.

The model is fitted once per session on the driver, on a documented, bounded number of generated
lines (``secrets_training``), and shipped to the tasks (under 1 MB). The texts are read in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm import crf, secrets_training
from lodesift.llm.secrets_codes import Coder, spans
from lodesift.llm.secrets_lexer import PRIVATE_BLOCK, features, name_class
from lodesift.session import ship

LABELS = ("O", "K", "S")
#: Generated lines the model is fitted to.
TRAINING_LINES = 12_000

@lru_cache(maxsize=2)
def model(lines: int = TRAINING_LINES, seed: int = 11, held: bool | None = None) -> crf.Model:
    """The fitted model; the same parameters give the same weights. ``held=False``: without the withheld templates."""
    seqs, tags, texts, _ = secrets_training.tagged(lines, seed, name_class, held)
    rows = [(s, y, t) for s, y, t in zip(seqs, tags, texts, strict=True) if s]
    return crf.train([features(s, t[s[-1].end :]) for s, _, t in rows], [y for _, y, _ in rows], LABELS)


#: Characters from which what was found in a statement isn't remembered.
LONG_LINE = 1 << 13
#: Characters of texts whose statements are held at a time; a longer text is held whole.
BLOCK = 1 << 22
#: Characters of statements that are labelled at a time; a longer statement is labelled whole.
BATCH = 1 << 18

_QUOTES = "\"'`"
# A line that ends so is taken on by a literal (or a parenthesis) on the next.
_ASSIGNS = re.compile(r"(?:[\w\])\"'`$]\s*(?:[:+.]|\?\?|\|\|)?=>?|[\w\"'-]\s*:)$")
_OPENS = re.compile(r"(?:[=:,]|=>)\s*\($")
_CONCATENATES = re.compile(r"[\"'`)]\s*(?:\+|\.{1,2}|<>|&)$")
_LITERAL_START = re.compile(r"\(|[A-Za-z]{0,2}[\"'`]")
_CONCATENATED = re.compile(r"(?:\+|\.{1,2}|<>|&)\s*[\"'`]")
_LONE = re.compile(r"[A-Za-z]{0,2}(?:\"[^\"]*\"|'[^']*')\s*[);,]*$")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")
_KEY = re.compile(r"\s*(?:- )?[\"']?([\w.-]+)[\"']?\s*:(\s*[|>][+-]?\d?[+-]?)?$")
_OPEN_TAG = re.compile(r"<([A-Za-z][\w.:-]*)>$")
_NAMING = frozenset(("cred", "key", "carrier"))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def statements(text: str) -> list[tuple[int, int]]:
    """The spans of the statements of a text: every line that isn't blank, with the lines it goes on over. Line ends are left out.

    A line goes on where it ends with a backslash, with a sign before a literal on the next line, within the parentheses of
    a call, or as a YAML key or an XML tag of a credential's name with the value below it; a key block joins the lines it spans.
    """
    blocks = [m.span() for m in PRIVATE_BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    spans: list[tuple[int, int]] = []
    at, n, k = 0, len(text), 0
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        while k < len(blocks) and blocks[k][0] < end:
            if blocks[k][1] > end:
                end = text.find("\n", blocks[k][1])
                end = n if end < 0 else end
            k += 1
        stop = end
        while stop > at and text[stop - 1] == "\r":
            stop -= 1
        spans.append((at, stop))
        at = end + 1
    out: list[tuple[int, int]] = []
    start, depth, literal, block, tag = -1, 0, False, -1, ""
    for i, (a, b) in enumerate(spans):
        line = text[a:b]
        s = line.strip()
        if not s:
            if start >= 0:
                out.append((start, spans[i - 1][1]))
                start = -1
            continue
        if start < 0:
            start, depth, literal, block, tag = a, 0, False, -1, ""
        following = text[spans[i + 1][0] : spans[i + 1][1]] if i + 1 < len(spans) else ""
        f = following.strip()
        goes_on = False
        if f:
            last = s[-1]
            if depth or "(" in s:
                plain = _STRING.sub("", s)
                depth = 0 if last in "{;" else max(0, depth + plain.count("(") - plain.count(")"))
            literal = literal or "=" in s or ":" in s or "(" in s
            if line.endswith("\\"):
                goes_on = (len(line) - len(line.rstrip("\\"))) % 2 == 1
            elif depth and last in "(,":
                goes_on = True
            elif last in "=>:(+.&":
                goes_on = _LITERAL_START.match(f) is not None and (_ASSIGNS.search(s) or _OPENS.search(s) or _CONCATENATES.search(s)) is not None
            elif last in _QUOTES:
                goes_on = _CONCATENATED.match(f) is not None or (literal and f[0] in "\"'bfru" and _LONE.match(f) is not None)
            if block >= 0:
                goes_on = _indent(following) > block
            elif not goes_on and last in ":|>+-" and _indent(following) > _indent(line):
                m = _KEY.match(line.rstrip())
                if m and name_class(m.group(1))[0] in _NAMING:
                    goes_on = True if m.group(2) else " " not in f and f[-1] != ":"
                    block = _indent(line) if m.group(2) else block
            if not goes_on and tag:
                goes_on = tag not in s
            elif not goes_on and last == ">" and f[0] != "<":
                m = _OPEN_TAG.search(s)
                if m and name_class(m.group(1))[0] in _NAMING:
                    goes_on, tag = True, f"</{m.group(1)}>"
        if not goes_on:
            out.append((start, b))
            start = -1
    return out


class Labeller:
    """Finds the spans of credentials in statements; remembers what it found in recent ones."""

    def __init__(self, fitted: crf.Model, remember: int = 200_000):
        self.fitted, self.remember = fitted, remember
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}
        self.coder = Coder(fitted)

    def learn(self, lines: Iterable[str]) -> None:
        new = set(lines)
        if len(self.known) + len(new) > self.remember:
            self.known = {}
        waiting: list[str] = []
        n = 0
        for s in new.difference(self.known):
            waiting.append(s)
            n += len(s)
            if n >= BATCH:
                self._label(waiting)
                waiting, n = [], 0
        self._label(waiting)

    def _label(self, lines: list[str]) -> None:
        if self.coder.full():
            self.coder.clear()
        self.known.update(zip(lines, spans(self.coder, lines, lambda scores, lengths: crf.decode_flat(self.fitted, scores, lengths), LABELS.index("S")), strict=True))

    def find(self, texts: Sequence[str | None]) -> list[list[tuple[int, int]]]:
        """The spans of each text, in code points from 0, in order; none for null and empty texts."""
        found: list[list[tuple[int, int]]] = []
        at = 0
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and n < BLOCK:
                n += len(texts[upto] or "")
                upto += 1
            block = [[(a, t[a:b]) for a, b in statements(t)] if t else [] for t in texts[at:upto]]
            self.learn(s for ls in block for _, s in ls)
            for ls in block:
                found.append([(a + x, a + y) for a, s in ls for x, y in self.known[s]])
            for ls in block:
                for _, s in ls:
                    if len(s) > LONG_LINE:  # long statements hardly come again
                        self.known.pop(s, None)
            at = upto
        return found


def _texts(df: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """``field, row_id, text``, a row per text column; null and empty texts are dropped."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.col(rid).cast("bigint").alias("row_id"), F.col(column).alias("text")) for name, (rid, column) in parts.items()])
    return df.select(F.explode(each).alias("x")).select("x.*").where(F.col("text") != "")


def find(texts: DataFrame, lines: int = TRAINING_LINES) -> DataFrame:
    """``field, row_id, start_pos, end_pos`` of each credential in ``texts`` (``field, row_id, text``).

    Places count code points from 0, ``end_pos`` is exclusive. Null and empty texts have none; repeated rows count
    each; texts are read whole, whatever their length; extra columns are ignored.
    """
    ship(texts.sparkSession)
    fitted = texts.sparkSession.sparkContext.broadcast(model(lines))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(fitted.value)
        for batch in batches:
            field, rid = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = labeller.find(batch.column(2).to_pylist())
            rows = [(field[i], rid[i], a, b) for i, s in enumerate(found) for a, b in s]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["field", "row_id", "start_pos", "end_pos"])

    return texts.select("field", "row_id", "text").mapInArrow(label, "field string, row_id long, start_pos int, end_pos int")


def redact(texts: DataFrame, mark: str = "[REDACTED]", lines: int = TRAINING_LINES) -> DataFrame:
    """``field, row_id, text, n_redacted``: the texts with a case, with only its characters replaced by ``mark``."""
    ship(texts.sparkSession)
    fitted = texts.sparkSession.sparkContext.broadcast(model(lines))

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(fitted.value)
        for batch in batches:
            field, rid, text = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for i, spans in enumerate(labeller.find(text)):
                if spans:
                    parts, at = [], 0
                    for a, b in spans:
                        parts += [text[i][at:a], mark]
                        at = b
                    out.append((field[i], rid[i], "".join(parts) + text[i][at:], len(spans)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True)], ["field", "row_id", "text", "n_redacted"])

    return texts.select("field", "row_id", "text").mapInArrow(replace, "field string, row_id long, text string, n_redacted int")


def source_texts(hook_inputs: DataFrame, findings: DataFrame) -> DataFrame:
    """The texts of hook events and findings that may hold credentials."""
    hooks = hook_inputs.select("input_id", F.col("tool_input.content").alias("content"), F.col("tool_input.new_string").alias("new_string"))
    return _texts(hooks, {"content": ("input_id", "content"), "new_string": ("input_id", "new_string")}).unionByName(_texts(findings.select("finding_id", "matched_text"), {"matched_text": ("finding_id", "matched_text")}))
