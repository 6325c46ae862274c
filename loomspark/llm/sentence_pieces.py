"""SentencePiece encoding and decoding by a table of distinct chunks.

In many models no piece has a white-space marker behind another character. What such a model makes of a text then
falls apart before every run of markers: a chunk (a run of markers and what follows up to the next) gets the same ids
wherever it stands. Documents are taken some megabytes at a time; their chunks are the strings between consecutive
offsets of one buffer, Arrow's dictionary encoding gives the table of the distinct ones and each chunk's place in it,
the sentencepiece library segments each distinct one once, and the ids join back by position.

Whether a model allows this is read off its pieces and its normaliser. If not, a text is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: Bytes of text that share a table; one longer text has its own.
TABLE_BYTES = 8 << 20
#: Distinct chunks, and their longest length, that a Python worker keeps with their ids from one table to the next.
KEPT = 1 << 18
KEPT_CHARS = 64
_SPACE = 0x20


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether ids of chunks are the ids of the text: spaces become markers and are otherwise kept, one more is put
    in front, and no piece has a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(_processor(path).serialized_model_proto())
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    kinds = model.SentencePiece
    own = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
    simple = not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) and not model.trainer_spec.treat_whitespace_as_suffix
    return bool(plain and simple and MARKER in own and not any(MARKER in p.lstrip(MARKER) for p in own))


@dataclass
class Table:
    """Distinct chunks of some documents with their ids, and the chunks of each document as places in it."""

    first: int
    rows: int
    ids: np.ndarray  # of all distinct chunks, one after the other
    starts: np.ndarray  # of each distinct chunk's ids, and the end
    place: np.ndarray  # of each chunk of each document
    bounds: np.ndarray  # of each document's chunks

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        total = np.concatenate(([0], np.cumsum(np.diff(self.starts)[self.place])))
        return np.diff(total[self.bounds])

    def joined(self) -> np.ndarray:
        """The ids of all documents, one after the other."""
        size = np.diff(self.starts)[self.place]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.starts[self.place] - before, size) + np.arange(int(size.sum()))]

    def decimals(self) -> list[str]:
        """Each document's ids as decimals joined by commas. A distinct chunk's are written once."""
        text, at, ends = list(map(str, self.ids.tolist())), self.starts.tolist(), self.bounds.tolist()
        written = [",".join(text[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return [",".join(map(written.__getitem__, self.place[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Segmenter:
    """The library's ids of distinct chunks. Those that came first, the frequent ones among them, are kept."""

    def __init__(self, path: str):
        self.sp, self.whole, self.kept = _processor(path), not separable(path), {}
        self.marker = [self.sp.piece_to_id(MARKER)]

    def _library(self, chunks: list[str]) -> list[list[int]]:
        """It puts a marker in front itself, so a chunk's first is left out; a marker alone, the end of a text, is a piece."""
        if self.whole:
            return self.sp.encode(chunks, out_type=int, num_threads=1)
        ids = self.sp.encode([c[1:] for c in chunks], out_type=int, num_threads=1)
        return [i if c != " " else self.marker for c, i in zip(chunks, ids, strict=True)]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        out = list(map(self.kept.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(new, self._library([chunks[i] for i in new]), strict=True):
            out[i] = ids
            if len(self.kept) < KEPT and len(chunks[i]) <= KEPT_CHARS:
                self.kept[chunks[i]] = ids
        return out


_segmenter = lru_cache(maxsize=2)(Segmenter)


def _chunk_table(segment: Segmenter, texts: pa.Array, first: int) -> Table:
    n, whole = len(texts), segment.whole
    if not whole:
        texts = pc.replace_substring(texts, MARKER, " ")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        texts = pc.if_else(pc.equal(texts, nothing), nothing, pc.binary_join_element_wise(space, texts, nothing))
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cut = np.zeros(len(held), bool)
    if not whole:
        cut[:] = held == _SPACE
        cut[1:] &= held[:-1] != _SPACE
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    ends = np.append(start, len(held)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(held)))
    coded = chunks.dictionary_encode()
    ids = segment.ids(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    return Table(first, n, flat, np.concatenate(([0], np.cumsum(sizes))), coded.indices.to_numpy(), np.searchsorted(start, offsets))


def tables(path: str, column: pa.Array, table_bytes: int = TABLE_BYTES) -> Iterator[Table]:
    """The tables of a column of texts, each of consecutive rows of about table_bytes."""
    column = column.fill_null("").cast(pa.large_string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    row = 0
    while row < len(column):
        before = total[row] - sizes[row]
        to = max(row + 1, int(np.searchsorted(total, before + table_bytes, "right")))
        yield _chunk_table(_segmenter(path), column.slice(row, to - row), row)
        row = to


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_tokens, ids array<int>), as the library encodes without further options.

    path is a model that every executor can read. Null and empty texts have no ids. Other columns, whatever their
    names, are ignored; rows stay as they are, repeated ones too, and nothing shuffles. An empty table gives an empty one."""

    def run(batches):
        for b in batches:
            for t in tables(path, b.column("text")):
                counts = t.counts()
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(t.joined()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, t.rows), pa.array(counts, pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> (doc_id, text), by the library's decode. Null and empty ids give an empty text."""

    def run(batches):
        decode = _processor(path).decode
        for b in batches:
            texts = [decode(ids) if ids else "" for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded as by encode_documents, and
    each document's ids decoded again by the library. Rows, nulls and other columns as there."""

    def run(batches):
        decode = _processor(path).decode
        for b in batches:
            for t in tables(path, b.column("text")):
                counts = t.counts()
                ids, at = t.joined(), np.concatenate(([0], np.cumsum(counts))).tolist()
                texts = (decode(ids[i:j].tolist()) if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True))
                digests = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in of]) for of in (t.decimals(), texts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, t.rows), pa.array(counts, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
