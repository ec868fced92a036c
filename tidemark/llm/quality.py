"""Quality rules, line first.

Every line is judged by itself: a line that is mostly symbols or shouting
(punctuation rules), a row of links or a bare label (navigation rules), a legal
note or an invitation (boilerplate rules) or a copy of an earlier line is taken
out. A document
then goes when the lines left hold too little of its text, when it is short, or
when repeated three-word windows cover most of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails when over a quarter of its words' number are symbols, or as many as 3 in 10 exclamation marks.
MAX_SYMBOLS_PER_WORD = 0.25
MAX_EXCLAMATIONS_PER_WORD = 0.3
#: Bars and arrows between links; this many make a line a navigation bar.
SEPARATORS = ("|", "»", "›", "·", "•")
MIN_SEPARATORS = 2
#: A line of so few words without any closing mark is a label, not a sentence.
LABEL_WORDS = 3
CLOSERS = ".!?:;,…\"'”’»)]。！？"
#: Stock phrases, in the syntax that Python, Java and RE2 share: legal ones anywhere in a line that is no long
#: paragraph, invitations at the start of a short line. Prose that has such words in passing stays.
LEGAL = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|licensed under the|copyright (\(c\)|©)"
    r"|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados"
)
LEGAL_WORDS = 25
INVITATION = r"(?i)^[^0-9A-Za-z]*(please )?(accept (all )?cookies|click here|read more|sign (up|in)|log in|subscribe (now|to))"
INVITATION_WORDS = 8
#: A document must keep this share of its word characters.
MIN_KEPT = 0.5

_LEGAL, _INVITATION = re.compile(LEGAL), re.compile(INVITATION)


def line_fails(line: str) -> str | None:
    """The name of the rule that takes ``line`` out, or None. A line without a
    word never fails."""
    words = len(line.encode().split())
    if not words:
        return None
    symbols = sum(map(line.count, "#*$%&|<>"))
    if symbols > MAX_SYMBOLS_PER_WORD * words or line.count("!") > MAX_EXCLAMATIONS_PER_WORD * words:
        return "punctuation"
    if sum(map(line.count, SEPARATORS)) >= MIN_SEPARATORS:
        return "navigation"
    if words <= LABEL_WORDS and line.rstrip(" \t\n\v\f\r")[-1] not in CLOSERS:
        return "navigation"
    if (words <= LEGAL_WORDS and _LEGAL.search(line)) or (words <= INVITATION_WORDS and _INVITATION.search(line)):
        return "boilerplate"
    return None


def _word_chars(line: str) -> int:
    return len(line) - sum(map(line.count, " \t\n\v\f\r"))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n = upto = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def judge(raw: bytes) -> tuple:
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    repeated = repeat_words(words)
    kept_lines, seen, dup, removed = [], set(), 0, 0
    total = left = 0
    for line in text.split("\n"):
        chars = _word_chars(line)
        total += chars
        if not chars:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line):
            removed += 1
        else:
            kept_lines.append(line)
            left += chars
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    kept = not failed and left >= MIN_KEPT * total
    return n, total, symbols, dup, repeated, failed, kept, removed, "\n".join(kept_lines)


_FIELDS = (
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("n_removed_lines", pa.int64()),
    ("clean_text", pa.string()),
)


def line_first(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), clean: bool = True) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, the base counts, the
    verdict ``kept``, ``n_removed_lines`` and, if ``clean``, ``clean_text`` (the
    text without its failed lines).

    Null and empty texts have no words, so they fail; a very long text is one
    row's work; repeated rows are judged alike; an empty table gives none.
    Columns of ``docs`` not in ``keep`` are ignored, whatever their names.
    Narrow: no shuffle, one Arrow batch in memory.
    """
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), body(text).alias("raw"))
    fields = _FIELDS if clean else _FIELDS[:-1]
    out_schema = ", ".join(
        [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
        + [f"{n} {({pa.int64(): 'long', pa.bool_(): 'boolean', pa.string(): 'string'})[t]}" for n, t in fields]
    )
    n_keys = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(raw.as_py()) for raw in b.column(n_keys)]
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                b.columns[:n_keys] + cols, names=b.schema.names[:n_keys] + [n for n, _ in fields]
            )

    out = src.mapInArrow(run, out_schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(n for n, _ in fields))
