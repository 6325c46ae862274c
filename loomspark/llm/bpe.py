"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a transducer whose states are made when they are first met. A state is the
bytes read since the last settled token boundary. After each byte it asks where a token that reaches beyond
what has been read could begin: at every i where the rest w[i:] is a proper prefix of some token, or at the
end. As a boundary at i leaves BPE(w[:i]) before it, whatever the continuation, the tokens that BPE(w[:i])
has in common for all those i are settled; they are emitted, and the state keeps the bytes after them. The
lookahead is bounded by the longest token.

Decoding is streamed: an incremental UTF-8 machine lets whole characters through and holds the first bytes of
one that a token boundary cuts.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a worker keeps of pieces and of states; it starts afresh beyond.
MAX_PIECES = 400_000
MAX_STATES = 400_000
#: Ids that the streaming decoder is fed at once.
DECODE_STEP = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces of text by merge ranks; states and transitions are made on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.open = {token[:i] for token in ranks for i in range(1, len(token))}
        self._reset()

    def _reset(self) -> None:
        self.pending = [b""]
        self.number = {b"": 0}
        self.next: list[dict[int, tuple[bytes, int]]] = [{}]
        self.flush: list[bytes | None] = [b""]

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a few bytes: of adjacent pairs the one of lowest rank is joined, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _ids(self, tokens: list[bytes]) -> bytes:
        return b"".join(self.ranks[t].to_bytes(4, "little") for t in tokens)

    def _step(self, state: int, byte: int) -> tuple[bytes, int]:
        word = self.pending[state] + bytes((byte,))
        settled: list[bytes] | None = None
        for i in range(len(word), -1, -1):
            if i < len(word) and word[i:] not in self.open:
                continue
            chain = self.merge(word[:i])
            if settled is None:
                settled = chain
            else:
                same = 0
                while same < min(len(settled), len(chain)) and settled[same] == chain[same]:
                    same += 1
                settled = settled[:same]
            if not settled:
                break
        rest = word[sum(map(len, settled or [])) :]
        to = self.number.get(rest)
        if to is None:
            to = self.number[rest] = len(self.pending)
            self.pending.append(rest)
            self.next.append({})
            self.flush.append(None)
        self.next[state][byte] = out = (self._ids(settled or []), to)
        return out

    def encode(self, piece: bytes) -> bytes:
        """The ids of a piece, four little-endian bytes each. A piece that is a token is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return rank.to_bytes(4, "little")
        if len(self.pending) > MAX_STATES:
            self._reset()
        out, state = [], 0
        for byte in piece:
            move = self.next[state].get(byte)
            if move is None:
                move = self._step(state, byte)
            if move[0]:
                out.append(move[0])
            state = move[1]
        last = self.flush[state]
        if last is None:
            last = self.flush[state] = self._ids(self.merge(self.pending[state]))
        out.append(last)
        return b"".join(out)


class Encoder:
    """Whole texts: split into pieces by the pattern, each encoded alone; pieces met before are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        known = self.known
        if len(known) > MAX_PIECES:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        return b"".join(map(known.__getitem__, pieces))


#: States of the UTF-8 machine by first byte: how many bytes follow, and the bounds of the second byte.
_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEAD = {b: (n, lo, hi) for first, last, n, lo, hi in _LEADS for b in range(first, last + 1)}


class Utf8Stream:
    """Bytes in, whole characters out. What can still become a character is held back."""

    def __init__(self) -> None:
        self.held = b""

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                follow, low, high = _LEAD.get(byte, (0, 0, 0))
                fits = back == 1 or low <= data[-back + 1] <= high
                return back if fits and back <= follow else 0
        return 0

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        out, self.held = self.held, b""
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode_stream(ids: np.ndarray, tokens: list[bytes]):
    """The bytes of ids, in pieces that never end within a character (but for broken input's last)."""
    stream = Utf8Stream()
    for at in range(0, len(ids), DECODE_STEP):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[at : at + DECODE_STEP].tolist())))
    yield stream.finish()


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    path is a rank file that every executor can read. Null and empty texts have no ids. Other columns are
    ignored; rows stay as they are, repeated ones too, and nothing shuffles."""

    def run(batches):
        encode = _encoder(path, pattern).encode
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> (doc_id, text): what encode_documents took. Broken UTF-8 is replaced."""

    def run(batches):
        tokens = _tokens(path)
        for b in batches:
            texts = [b"".join(decode_stream(np.frombuffer(x or b"", "<u4"), tokens)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids."""

    def run(batches):
        tokens = _tokens(path)
        for b in batches:
            encoded, decoded = [], []
            for x in b.column("ids").to_pylist():
                encoded.append(hashlib.sha256(x).hexdigest())
                text = hashlib.sha256()
                for piece in decode_stream(np.frombuffer(x, "<u4"), tokens):
                    text.update(piece)
                decoded.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ids = encode_documents(documents, path, pattern)
    return ids.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
