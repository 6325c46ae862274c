"""Order-preserving packing of documents into token sequences.

The documents of a partition, in their order, are one stream of ids. It is cut into sequences at document
ends (free), sentence ends (a small penalty) or inside a sentence (a larger one), so that padding plus
penalties is least. Every document and sentence end is offered, and places STRIDE apart in every gap between
them. Padding falls by one for each token that a sequence gains, so the best last cut before a place minimises
cost + position over a sliding window: a monotone queue keeps it at hand. A sequence whose length is a power
of two needs no padding; those few cuts are looked up by position.

The programme runs over the partition's whole stream, block by block: its costs and its queue go on from one block
to the next. After a block, the cuts that lie on the ways to all places from which a sequence may still start are
final; their pieces are given out and forgotten. The cutting is the cheapest of the stream whatever the size of a
block, and held is the part that is not decided yet. Partitions are those of the scan: no row moves.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 24
#: Cuts inside a sentence are offered so far apart.
STRIDE = 16
#: What ends a sentence beside Unicode's sentence terminals: line and paragraph ends, ellipsis, Tibetan shads.
MORE_ENDS = "\n\x85\u2028\u2029\u2026\u0f0d\u0f0e"
#: Ids after which the programme goes on and decided cuts are given out; results do not depend on it.
BLOCK = 1 << 17
#: What follows a document's ids.
SEPARATOR = 0

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(maxsize=1)
def _marks() -> list[np.ndarray]:
    """The signs that end a sentence, as numbers of their UTF-8 bytes: those of one byte, of two, three, four."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    coded = [x.encode() for x in {*regex.findall(r"\p{Sentence_Terminal}", every), *MORE_ENDS}]
    return [np.array(sorted(int.from_bytes(x) for x in coded if len(x) == n), np.uint64) for n in range(1, 5)]


class Sentences:
    """Which places of a stream end a sentence. A sign's bytes may be spread over several tokens."""

    def __init__(self, tokens: list[bytes]):
        """tokens: each id's bytes. A quote after the sign in the same token belongs to the sentence."""
        kept = [(x.rstrip(b'"') or x)[-4:] for x in tokens]
        self.tail = np.array([int.from_bytes(x) for x in kept], np.uint64)
        self.width = np.array([len(x) for x in kept], np.uint64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The places after ids that end a sentence, ascending."""
        own, width = self.tail[ids], self.width[ids]
        last, have = own.copy(), width.copy()
        for back in range(1, 4):
            last[back:] |= own[:-back] << (np.uint64(8) * np.minimum(have[back:], np.uint64(4)))
            have[back:] += width[:-back]
        one, *longer = _marks()
        found = np.isin(last & np.uint64(0xFF), one, kind="table")
        other = np.flatnonzero(last & np.uint64(0x80))
        for n, marks in enumerate(longer, 2):
            found[other] |= np.isin(last[other] & np.uint64(256**n - 1), marks)
        return np.flatnonzero(found) + 1


def _token_bytes(vocabulary: dict[str, int], size: int) -> list[bytes]:
    """Each id's bytes, from the characters that byte-level vocabularies write them in."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = [b""] * size
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks: str | None, pattern: str):
    """text -> ids as the tokenizers library has them; and where ids end sentences.

    The rank file holds the same vocabulary for tiktoken, which is some times faster; the two libraries'
    character classes may differ on rare characters, so it takes texts of Latin letters only, and none that hold
    a token which the vocabulary adds to its merges: that is one id."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    vocabulary = slow.get_vocab()
    sentences = Sentences(_token_bytes(vocabulary, max(vocabulary.values()) + 1))

    def by_tokenizer(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if not ranks:
        return by_tokenizer, sentences
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    rare = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]").search
    added = [x.content for x in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if (text.isascii() or not rare(text)) and not any(x in text for x in added):
            return fast(text)
        return by_tokenizer(text)

    return encode, sentences


class Cutting:
    """The cheapest cutting of a stream whose places (ascending, gaps at most length, from 0) come part by part.

    Cost: for every sequence length - tokens, or nothing where that number is a power of two, plus the
    penalty of the cut that ends it. Place 0 of the lists is the last cut given out."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.pos, self.cost, self.back = [0], [0], [0]
        self.queue, self.worth, self.head = [0], [0], 0  # candidates by position, their cost + position ascending

    def extend(self, positions: np.ndarray, penalties: np.ndarray) -> None:
        """positions come after all earlier ones."""
        if not len(positions):
            return
        length, pos, cost, back, queue, worth, head = self.length, self.pos, self.cost, self.back, self.queue, self.worth, self.head
        first, old = len(pos), bisect_right(pos, int(positions[0]) - length - 1)
        near = np.concatenate((np.array(pos[old:], np.int64), positions))
        special: dict[int, list[int]] = {}
        power = 1
        while power <= length:
            at = np.searchsorted(near, positions - power)
            for j in np.flatnonzero(near[at] == positions - power).tolist():
                special.setdefault(first + j, []).append(old + int(at[j]))
            power *= 2
        for j, (p, penalty) in enumerate(zip(positions.tolist(), penalties.tolist(), strict=True), first):
            while pos[queue[head]] < p - length:
                head += 1
            i = queue[head]
            least = worth[head] + length - p
            if j in special:
                for k in special[j]:
                    if cost[k] < least:
                        least, i = cost[k], k
            least += penalty
            pos.append(p)
            cost.append(least)
            back.append(i)
            value = least + p
            while len(queue) > head and worth[-1] >= value:
                queue.pop()
                worth.pop()
            queue.append(j)
            worth.append(value)
        self.head = head

    def settled(self) -> list[int]:
        """The cuts that every continuation has, beyond those given out before."""
        pos, back = self.pos, self.back
        live = bisect_right(pos, pos[-1] - self.length)  # a later place is at least one further on
        heap = [-j for j in range(live, len(pos))]
        heapq.heapify(heap)
        last = -heap[0]
        while heap:
            last = -heapq.heappop(heap)
            while heap and heap[0] == -last:
                heapq.heappop(heap)
            if heap:
                heapq.heappush(heap, -back[last])
        out = self._way(last)
        if last:
            self.pos, self.cost, self.back = pos[last:], self.cost[last:], [j - last for j in back[last:]]
            self.queue, self.worth, self.head = [j - last for j in self.queue[self.head :]], self.worth[self.head :], 0
        return out

    def close(self) -> list[int]:
        """The cuts up to the last place, which always is one."""
        return self._way(len(self.pos) - 1)

    def _way(self, j: int) -> list[int]:
        out = []
        while j > 0:
            out.append(self.pos[j])
            j = self.back[j]
        return out[::-1]


def cuts(positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into positions (ascending, 0 first, gaps at most length) where the cheapest cutting cuts."""
    cutting = Cutting(length)
    cutting.extend(positions[1:], penalties[1:])
    return np.searchsorted(positions, cutting.close()).tolist()


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentences: Sentences, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and the penalty of each place. 0 and all document ends are among them."""
    natural = np.unique(np.concatenate(([0], sentences.ends(ids), doc_ends)))
    step = min(STRIDE, length)
    more = (np.diff(natural) - 1) // step  # places inside each gap
    first = np.cumsum(more) - more
    inner = np.repeat(natural[:-1], more) + (np.arange(more.sum()) - np.repeat(first, more) + 1) * step
    every = np.sort(np.concatenate((natural, inner)))
    penalty = np.full(len(every), INSIDE_PENALTY)
    penalty[np.searchsorted(every, natural)] = SENTENCE_PENALTY
    penalty[np.searchsorted(every, doc_ends)] = 0
    penalty[0] = 0
    return every, penalty


@dataclass
class Packer:
    """The stream of one partition. add() and close() return the pieces of sequences that are decided."""

    sentences: Sentences
    first_sequence: int
    length: int = LENGTH
    block: int = 0
    cutting: Cutting = field(init=False)
    held: list = field(default_factory=list)  # ids that the programme has seen and that are not given out
    fresh: list = field(default_factory=list)  # ids, and their numbers a document, that it has not seen
    docs: list = field(default_factory=list)  # (doc_id, ids given out, ids in all)
    start: int = 0  # place of held in the stream
    size: int = 0
    due: int = 0
    sequences: int = 0

    def __post_init__(self):
        self.cutting = Cutting(self.length)
        self.block = self.due = self.block or BLOCK

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.fresh.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.size += len(ids)
        return self._cut(False) if self.size >= self.due else []

    def close(self) -> list[tuple]:
        return self._cut(True) if self.size else []

    def _cut(self, everything: bool) -> list[tuple]:
        if self.fresh:
            ids = np.concatenate(self.fresh)
            places, penalties = candidates(ids, np.cumsum([len(x) for x in self.fresh]), self.sentences, self.length)
            self.cutting.extend(places[1:] + (self.start + self.size - len(ids)), penalties[1:])
            self.held, self.fresh = [*self.held, ids], []
        at = np.array(self.cutting.close() if everything else self.cutting.settled(), np.int64) - self.start
        out = self._pieces(at) if len(at) else []
        self.due = max(self.block, 2 * self.size)  # so that what stays undecided is not walked too often
        return out

    def _pieces(self, at: np.ndarray) -> list[tuple]:
        ids = np.concatenate(self.held)
        ends = np.cumsum([total - before for _, before, total in self.docs])
        done = int(at[-1])
        edges = np.unique(np.concatenate(([0], at, ends[ends < done])))
        begin, end = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(at, begin, "right")
        seq_start = np.concatenate(([0], at))[seq]
        raw, out = memoryview(np.ascontiguousarray(ids).view(np.uint8)), []
        doc_start = np.concatenate(([0], ends))
        for b, e, d, s, o in zip(begin.tolist(), end.tolist(), doc.tolist(), seq.tolist(), (begin - seq_start).tolist(), strict=True):
            doc_id, before, total = self.docs[d]
            piece = raw[b * 4 : e * 4]
            out.append((doc_id, before + b - int(doc_start[d]), e - b, zlib.crc32(piece), total, self.first_sequence + self.sequences + s, o, piece))
        self.sequences += len(at)
        open_doc = int(np.searchsorted(ends, done, "right"))
        rest = self.docs[open_doc:]
        if rest:
            doc_id, before, total = rest[0]
            rest[0] = (doc_id, before + done - int(doc_start[open_doc]), total)
        self.docs, self.held, self.size, self.start = rest, [ids[done:].copy()], len(ids) - done, self.start + done
        return out


def pack_documents(documents: DataFrame, path: str, ranks: str | None = None, pattern: str = "", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """documents (doc_id, text) -> the pieces of its sequences, PIECE; ids only if with_ids.

    Each document's ids, a separator after them, are split into one or more pieces; those of a sequence have
    its sequence_id and their offset in it. start is a piece's place in its document. A null text is empty
    and has only its separator. Rows keep the order that they are read in, within a partition; repeated
    rows are documents of their own. path and ranks are vocabulary files that every executor can read. Other
    columns are ignored; an empty table gives an empty one."""
    schema = PIECE.format(id=documents.schema["doc_id"].dataType.simpleString())

    def run(batches):
        encode, sentences = _tokenizer(path, ranks, pattern)
        packer = Packer(sentences, TaskContext.get().partitionId() << 40, length)
        names, kinds = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None

        def table(pieces):
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array(columns[0], kinds), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([bytes(x) if with_ids else None for x in columns[7]], pa.binary())], ["doc_id", *names, "ids"])

        for b in batches:
            kinds = b.column("doc_id").type
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text) if text else []
                    ids.append(SEPARATOR)
                    if pieces := packer.add(doc_id, np.array(ids, np.uint32)):
                        yield table(pieces)
        if pieces := packer.close():
            yield table(pieces)

    out = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")
