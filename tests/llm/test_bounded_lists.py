"""What enters candidate lists grows with what repeats, not with the square of all keys or of a group."""

import numpy as np
import pyarrow as pa

from loomspark.llm import batch, components, line_dedup, ngram_join, repeats
from loomspark.llm.store import Scratch


def _bits(told, merge):
    found = np.zeros((repeats._RANGES, repeats._SPAN // 8), np.uint8)
    for b in merge(iter(told)):
        for r, bits in zip(b.column("range").to_pylist(), b.column("bits").to_pylist(), strict=True):
            found[r] = np.frombuffer(repeats.zlib.decompress(bits), np.uint8)
    return found.ravel()


def test_few_unique_keys_pass_by_chance():
    keys = batch.random_values(1 << 21, 9)
    keys[-1000:] = keys[:1000]
    told = [repeats._tell([repeats.places(x)], []) for x in np.split(keys, 2)]
    passed = repeats.may_repeat(_bits(told, repeats._merge), keys)
    assert passed[:1000].all() and passed[-1000:].all()
    assert passed.sum() < 2200  # one bitmap of 2**28 places alone lets some 18,000 pass


def test_ranges_in_order_give_the_same():
    rng = np.random.default_rng(4)
    pool = batch.random_values(3000, 6)
    told = [repeats._tell([repeats.places(pool[rng.integers(0, 3000, 1500)])], [rng.integers(0, 3, 1500).astype(np.uint16)]) for _ in range(3)]
    rows = pa.Table.from_batches(told).sort_by("range").combine_chunks()
    parts = [b for i in range(0, rows.num_rows, 700) for b in rows.slice(i, 700).to_batches()]
    want = _bits(told, repeats._merge)
    assert want.any() and (_bits(parts, repeats._merge_in_order) == want).all()


def test_sets_of_their_own_leave_lists(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"o{d}x{i}" for i in range(40)) for d in range(20)]
    near = [f"{passage} " + " ".join(f"n{i}" for i in range(40)) + f" end{d}" for d in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    rows = ngram_join._partnered(docs, docs.select("doc_id"), 4, 85, scratch).collect()
    assert sorted(r["doc_id"] for r in rows) == [20, 21]
    assert all(r["shared"] == r["n"] - 1 and len(r["set"]) == 8 * r["n"] for r in rows)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, k=4, percent=85).collect()}
    assert got == {d: min(d, 20) for d in range(22)}


def test_fitting_alone_is_what_pairs_need(spark):
    pairs = spark.createDataFrame([(n, pos, m) for n in range(1, 40) for pos in range(n) for m in range(1, 40)], "n int, pos int, least int")
    some = pairs.withColumn("links", components.fitting("n", "pos", "least", "0", 85)).withColumn("alone", components.fitting_alone(85))
    # A set that fits one of m elements is never told to leave a list of m elements or more.
    assert some.where("links and not alone").isEmpty()
    assert not some.where("not alone and 100 * least(n, least) >= 85 * greatest(n, least)").isEmpty()


def test_keys_of_lines_are_computed_once():
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["a line of some words\nanother line of words", "a line of some words\n\nthird"]})
    (spread,) = line_dedup._spread(iter([b]))
    assert spread.column("line_no").to_pylist() == [0, 1, 0, 2]
    assert [len(x) % line_dedup.BANDS for x in spread.column("keys").to_pylist()] == [0] * 4 and not spread.column("keys").to_pylist()[2]
    for part in (spread, spread.slice(1)):
        ((keys, line),) = line_dedup._keys_and_lines(iter([part]))
        want = [(k, x) for ks, x in zip(part.column("keys").to_pylist(), part.column("line").to_pylist(), strict=True) for k in ks]
        assert list(zip(keys.view(np.int64).tolist(), line.tolist(), strict=True)) == want
