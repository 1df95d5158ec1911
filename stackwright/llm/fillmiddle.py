"""Fill-in-middle transformation with a constant-memory two-pass matcher.

A text is a row of units, each the white space before a word with the word, or the white space at the end. The first pass
lets the matcher run over the text and counts its units; the two cuts follow from that count and from a
hash of the document's id. The second pass starts a new lazy iterator of matches and advances it to
the smaller and then to the larger cut. No list of units or of their places is ever made: besides the text
and its output a task holds one match.

Null texts count as empty. Empty texts, texts that hold a sentinel, and a share of the others stay plain. Repeated rows
with one id are cut alike; a row without doc_id is cut as if its id were the empty string. Texts of any length are
read whole. Other columns of the input are not looked at. A table without rows gives none.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from stackwright.llm.common import groups_of, texts_of

#: Sentinels in front of the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit of a text (fixed value).
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
#: Texts leave a task in groups of about so many characters.
GROUP_CHARS = 2_000_000


def draws(doc_id: object, seed: int = 42) -> list[int]:
    """Four 32-bit numbers that depend on the id and the seed alone."""
    digits = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def count_units(text: str) -> int:
    """First pass."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def cut_places(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the first and the second rank of units end, as places in the text."""
    matches = UNIT.finditer(text)
    a = _advance(matches, first, 0)
    return a, _advance(matches, second - first, a)


def _advance(matches: Iterator[re.Match], n: int, at: int) -> int:
    last = deque(islice(matches, n), maxlen=1)
    return last[0].end() if last else at


def transform(text: str, doc_id: object, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text. rate: percent that is cut; spm_rate: percent of
    these that take the form with the suffix first."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = cut_places(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of. No part holds a sentinel and no sentinel can begin inside a part
    and end beyond it, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    left, _, rest = output[len(first) :].partition(second)
    right, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(doc_id, n long, form string, prefix_chars, middle_chars long, output, restored string) of each text. One
    narrow Arrow pass, no shuffle; a document's result depends on its id, its text and the parameters alone."""

    def work(batches):
        names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            texts, doc_ids = texts_of(batch), batch.column(id_col)
            for a, b in groups_of([len(t) for t in texts], GROUP_CHARS):
                ids = doc_ids.slice(a, b - a)
                rows = [transform(t, i, seed, rate, spm_rate) for t, i in zip(texts[a:b], ids.to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                back = pa.array([restore(output, form) for _, form, _, _, output in rows], pa.string())
                yield pa.RecordBatch.from_arrays([ids, *columns, back], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].alias("text")).mapInArrow(work, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
