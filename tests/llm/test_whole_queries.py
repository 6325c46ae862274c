"""Registered queries of secret scans, BPE and sharding over all documents, against plain versions written apart."""

import base64
import hashlib
import itertools
import re

import pyarrow.parquet as pq
import pytest

from loomspark.llm.queries import QUERIES, SHARDS, pattern, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def test_secret_scan(spark):
    # The smallest tables hold no secret.
    documents = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op1_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(documents)
    total = 0
    for d in documents:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, rule, holds) in enumerate(RULES) for m in rule.finditer(d["text"] or "") if holds(m)]
        row = got[d["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        written = [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]
        assert row["base_sha256"] == sha(",".join(written))
        assert set(written) <= set(row["spans"].split(","))
        total += len(spans)
    assert total > 10


def test_bpe_round_trip(spark, documents):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in documents:
        ids = encoding.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(encoding.decode_bytes(ids))))
    got = QUERIES["op4_bpe_round_trip"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sharding(spark, documents):
    """Every shard walks its slots in its own order; in turns each takes the next one that is free."""
    size, owner = 65537, {}

    def walk(name):
        digest = sha(name)
        first, step = int(digest[:16], 16) % size, int(digest[16:32], 16) % (size - 1) + 1
        for j in itertools.count():
            yield (first + j * step) % size

    walks = [walk(name) for name in SHARDS]
    for turn in itertools.cycle(range(len(SHARDS))):
        if len(owner) == size:
            break
        owner[next(slot for slot in walks[turn] if slot not in owner)] = turn
    want = []
    for d in documents:
        slot = int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:15], 16) % size
        want.append((d["doc_id"], slot, owner[slot], SHARDS[owner[slot]]))
    assert sorted(map(tuple, QUERIES["op5_sharding"](spark, SF).select("doc_id", "slot", "shard_id", "shard").collect())) == sorted(want)
