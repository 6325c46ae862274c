"""Fill-in-the-middle, Merkle manifest and SentencePiece against plain versions, on edge rows and on the test tables."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark.llm import fill_middle, merkle, sentence_pieces
from loomspark.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
MODEL = vocabulary("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet \n" * 40_000
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", " a  b ", "▁a▁ b", "a\tb\nc\r\n\r d", "é😀 日本語テキスト 漢字", "x" * 3000, " " * 300, "<s> </s> <unk> <0x41>", "a<P>b", "tail<S", "P>head", "<<<", "é   ﬁ ①", "nul\0byte",
    "twice the same", "twice the same", LONG,
]
#: Names that the operators use inside; lang and n_chars are theirs by contract.
CLASH = "n int, form string, output string, key string, hash string, pos long, total long, tie long, steps string, ids string, n_tokens int, root int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab ▁\n<PSM>é日 ") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = [(i - 3 if i != 5 else None, t, [None, "en", "é", "z", "fr"][i % 5], ["web", None][i % 2], None if i % 4 == 0 else i) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (rows[8][0], "other text of the same id", "en", "web", 7)]
    return spark.createDataFrame([(*r, *([None] * 12)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}").cache()


def plain_fim(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    spm = h[3] % 100 < 20
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if spm else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text)


def fim_rows(documents):
    made = fill_middle.transform(documents)
    return [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)).collect()]


def test_fim_on_edges(edge):
    want = [plain_fim(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert sorted(fim_rows(edge), key=repr) == sorted(want, key=repr)
    assert fim_rows(edge.limit(0)) == []


def test_fim_query_on_all_documents(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = QUERIES["op11_fill_in_middle"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_fim(r["doc_id"], r["text"]) for r in docs), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_offsets_whatever_the_block(block):
    for text in ("", "a", "日本\r\n😀é", "ab\n" * 50, "x" * 64, "y" * 65, "é" * (2 * fill_middle.SEGMENT + 5) if block == 64 else "z"):
        o = fill_middle.Offsets(text, block)
        assert o.n == len(text)
        assert all(o.start(i) == i for i in sorted({0, 1, len(text) // 2, len(text) - 1, len(text)}) if 0 <= i <= len(text))


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> result rows, by whole trees."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (lang, built) in enumerate(zip(order, trees, strict=True)):
        for i, (_, _, first, r) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            doc_id, source, _, n_chars, text = r
            now = first
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
                now = leaf(doc_id, source, lang, n_chars + 1, text)
            proof, at = [], i
            for level in [*built[:-1], *top[:-1]]:
                if level is top[0]:
                    at = k
                run = level[at & ~1 : (at & ~1) + 2]
                proof += run[:at & 1] + run[(at & 1) + 1 :]
                run[at & 1] = now
                now, at = sha("".join(run)), at >> 1
            out.append((doc_id, first, built[-1][0], top[-1][0], sha("".join(proof)), now, now == top[-1][0]))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize(("levels", "top"), [(12, 4096), (1, 2), (1, 3), (2, 2), (2, 5), (3, 8), (4, 6), (5, 64)])
def test_manifest_on_edges(edge, levels, top):
    want = plain_manifest([tuple(r) for r in edge.select(*FIELDS).collect()])
    got = [tuple(r) for r in merkle.manifest(edge, levels, top).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_manifest_of_few_rows(spark, edge):
    assert merkle.manifest(edge.limit(0)).collect() == []
    for n in (1, 2, 3):
        rows = [(i, "s", "en" if n < 3 else f"l{i}", 5, "t") for i in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(rows), key=repr)


@pytest.mark.parametrize(("levels", "top"), [(1, 4), (2, 6)])
def test_manifest_of_many_languages(spark, levels, top):
    rows = [(i, None, f"l{i % 37}" if i % 37 else None, i, f"text {i}") for i in range(80)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string"), levels, top).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_query_on_all_documents(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest([tuple(r[c] for c in FIELDS) for r in docs]), key=repr)


def plain_pieces(sp, doc_id, text):
    ids = sp.encode(text or "", out_type=int, num_threads=1)
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")


def test_pieces_on_edges(edge):
    sp = sentence_pieces._processor(MODEL)
    rows = edge.select("doc_id", "text").collect()
    got = sentence_pieces.round_trip(edge, MODEL).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_pieces(sp, r["doc_id"], r["text"]) for r in rows), key=repr)
    encoded = sentence_pieces.encode_documents(edge, MODEL)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()), key=repr) == sorted(((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in rows), key=repr)
    decoded = sentence_pieces.decode_documents(encoded, MODEL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in decoded), key=repr) == sorted(((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in rows), key=repr)
    assert sentence_pieces.round_trip(edge.limit(0), MODEL).collect() == []


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_pieces_whatever_the_table(monkeypatch, size):
    import pyarrow as pa

    sp, texts = sentence_pieces._processor(MODEL), [t for t in TEXTS if t != LONG]
    for whole in (False, True):
        for part in (pa.array(texts, pa.string()), pa.array(["skip", *texts], pa.string()).slice(1)):
            segment = sentence_pieces.Segmenter(MODEL)
            segment.whole = whole
            monkeypatch.setattr(sentence_pieces, "_segmenter", lambda path, s=segment: s)
            made = list(sentence_pieces.tables(MODEL, part, size))
            assert sum(t.rows for t in made) == len(texts)
            want = [sp.encode(t or "") for t in texts]
            assert [x for t in made for x in t.decimals()] == [",".join(map(str, i)) for i in want]
            assert [x for t in made for x in t.joined().tolist()] == [x for i in want for x in i]
            assert [x for t in made for x in t.counts().tolist()] == [len(i) for i in want]


def test_model_is_separable():
    assert sentence_pieces.separable(MODEL)


def test_pieces_query_on_all_documents(spark):
    sp = sentence_pieces._processor(MODEL)
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = QUERIES["op13_sentence_pieces"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_pieces(sp, r["doc_id"], r["text"]) for r in docs), key=repr)
