"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together in another order.

The tokenizers library's Split pre-tokenizer, with isolated matches of a pattern, gives code-point offsets without
any training. A text is split in matches of up to BLOCK code points; the last match is split again into single code
points, so that the lengths of the two offset arrays give n. A cut of rank r lies in match r // BLOCK, which is split
again as well: its offset array, read at r % BLOCK, says where the cut is. A single split of every code point gives
the same cuts and takes a Python object for each.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Code points of a coarse match, and of what is split in one call.
BLOCK = 64
SEGMENT = BLOCK << 12
SEED = 1
TRANSFORM_PERCENT = 90
SPM_PERCENT = 20
_ROWS = 256


@lru_cache(maxsize=4)
def _splitter(width: int):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(r"[\s\S]{1,%d}" % width), "isolated")


def _spans(text: str, width: int) -> list[tuple[int, int]]:
    """Code-point offsets of the matches, left to right."""
    split = _splitter(width).pre_tokenize_str
    if len(text) <= SEGMENT:
        return [span for _, span in split(text)]
    return [(a + at, b + at) for at in range(0, len(text), SEGMENT) for _, (a, b) in split(text[at : at + SEGMENT])]


class Offsets:
    """The code points of one text: how many there are, and where the one of a given rank starts."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        self.spans = _spans(text, block)
        self.n = block * (len(self.spans) - 1) + len(self._inner(len(self.spans) - 1)) if self.spans else 0

    def _inner(self, match: int) -> list[tuple[int, int]]:
        a, b = self.spans[match]
        return _spans(self.text[a:b], 1)

    def start(self, rank: int) -> int:
        """Where the code point of this rank (from 0) starts; of rank n, where the text ends."""
        if rank == self.n:
            return self.spans[-1][1] if self.spans else 0
        match, inner = divmod(rank, self.block)
        return self.spans[match][0] + self._inner(match)[inner][0]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit integers that depend on the seed and the document's id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform_text(text: str, drawn: tuple[int, int, int, int], percent: int = TRANSFORM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    units = Offsets(text)
    one, two, three, four = drawn
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= percent:
        return units.n, PLAIN, None, None, text
    low, high = sorted((one % (units.n + 1), two % (units.n + 1)))
    a, b = units.start(low), units.start(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm_percent:
        return units.n, SPM, low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, PSM, low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(documents: DataFrame, seed: int = SEED, percent: int = TRANSFORM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), a row for each row.

    The draws depend on seed and doc_id, so repeated rows get equal results and a lost task repeats its own. Null and
    empty texts, and those that hold a mark already, are plain: output is the text, the two counts are null. A null
    doc_id draws as an empty id. Other columns, whatever their names, are ignored; an empty table gives an empty one.
    Nothing shuffles."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                made = [transform_text(text or "", draws(doc_id, seed), percent, spm_percent) for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                n, form, before, inside, output = zip(*made, strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of, read off the output and its form. No text that was transformed holds a
    mark, so the first of each kind is the one that was put there. The marks are of one length."""
    to_end = F.lit((1 << 31) - 1)
    body = F.substring(output, F.lit(len(PREFIX) + 1), to_end)
    first = F.when(form == PSM, F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substring(body, F.length(first) + len(SUFFIX) + 1, to_end)
    last = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(last) + len(MIDDLE) + 1, to_end)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))
