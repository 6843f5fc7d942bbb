"""Vector codes by a trie, byte-level BPE in chunks, fill-in-middle."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulens.llm import byte_bpe, fill_middle, vector_trie

# ---- vector codes --------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) and the codebooks, by loops over all entries."""
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [int(np.floor(x * 256)) for x in v], label) for i, v, label in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    book = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def closest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                held[p, closest(part, p)[1]].append(part)
        for (p, k), there in held.items():
            book[p][k] = tuple(sum(x) // len(there) for x in zip(*there))
    out, totals = [], defaultdict(int)
    for i, v, label in kept:
        best = [closest(part, p) for p, part in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        totals[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, __v int, `n.x` string, __c int"


def vector_rows(n, d, seed, steps=0):
    turn = random.Random(seed)
    value = lambda: turn.randint(-steps, steps) / 256 if steps else turn.gauss(0, 1)
    return [(i * 7 % n, [value() for _ in range(d)], turn.choice([1, 1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("n, d, steps, leaves", [(300, 32, 0, 4096), (300, 48, 2, 7), (200, 64, 1, 1), (40, 16, 3, 64)])
def test_codes_by_brute_force(spark, monkeypatch, n, d, steps, leaves):
    monkeypatch.setattr(vector_trie, "LEAVES", leaves)
    rows = vector_rows(n, d, n + d, steps)
    rows += [rows[0], rows[1], (None, rows[2][1], None), (5, None, 1), (6, [None] * d, 1), (7, [float("nan")] * d, 1), (8, [float("inf")] * d, 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in vector_trie.code_report(df).collect()), key=str)
    assert got == brute_codes(rows)


@pytest.mark.parametrize("share", [1e-4, 0.3, 2.0])
def test_totals_of_hot_and_other_labels(spark, monkeypatch, share):
    monkeypatch.setattr(vector_trie, "HOT_SHARE", share)
    df = spark.createDataFrame([(i, [0, 0, 0, 1, 2, None][i % 6], i) for i in range(600)], "i int, k int, x long")
    got = {(r.k, r.t) for r in vector_trie.with_total(df, "k", "x", "t").collect()}
    want = defaultdict(int)
    for i in range(600):
        want[[0, 0, 0, 1, 2, None][i % 6]] += i
    assert got == set(want.items()) and vector_trie.with_total(df, "k", "x", "t").count() == 600


def test_codes_of_awkward_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1, 0, "x", 0), (2, [1.0] * 32, 1, 0, "x", 0), (3, [1.0] * 5, 2, 0, "x", 0), (4, [], 2, 0, "x", 0)], VECTORS)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_trie.code_report(df).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, None)}
    only_empty = df.where("vec_id = 4")
    assert [(r.code, r.error) for r in vector_trie.code_report(only_empty).collect()] == [("00" * 16, 0)]
    assert vector_trie.code_report(df.where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_trie.code_report(spark.createDataFrame([(1, [1e9] * 16, 1, 0, "x", 0)], VECTORS)).count()


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame([(*r, 0, "x", 0) for r in vector_rows(50, 32, 3, 4)], VECTORS)
    book = vector_trie.fit(df)
    coded = vector_trie.encode(df, book)
    assert coded.columns == [*df.columns, "code", "error"]
    for r in coded.withColumn("back", vector_trie.decoded(F.col("code"), book)).collect():
        assert round(sum((256 * a - 256 * b) ** 2 for a, b in zip(r.embedding, r.back))) == r.error
    # Fewer vectors than entries: every vector is an entry of its own.
    assert coded.agg(F.max("error")).first()[0] == 0


def test_trie_shares_prefixes():
    parts = np.array(sorted({(a, b, c) for a in range(3) for b in range(3) for c in range(40)}))
    entries = np.array([[0, 0, 5], [2, 2, 30], [1, 1, 1]])
    codes, errors = vector_trie.nearest(parts, entries)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (codes == every.argmin(1)).all() and (errors == every.min(1)).all()


# ---- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})


PIECES = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "don't", "é", "ß", "😀", "1", "42", "!", "...", " ", "　", "\x00", "的", "<|endoftext|>"]


def test_tokens_of_chunks_are_the_librarys(library):
    encoder, turn = byte_bpe.Encoder(byte_bpe.load_ranks()), random.Random(3)
    unpacked = lambda b: np.frombuffer(b, np.int32).tolist()
    texts = ["".join(turn.choice(PIECES) for _ in range(turn.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 3000, "ab!" * 2000, " " * 3000, "\n \n" * 900, "".join(turn.choice("abcdefgh") for _ in range(4000))]
    for text in texts:
        want = library.encode_ordinary(text)
        assert unpacked(encoder.packed(text)) == want
        chunks = byte_bpe.cut(text, turn.randint(1, 20), turn.randint(0, 6))
        assert unpacked(byte_bpe.stitched([encoder.chunk(c[4], c[1], c[2], c[3]) for c in chunks])) == want
        assert sum(len(c[4]) for c in chunks) <= 3 * len(text) + 200


def test_unsynchronised_chunks_are_an_error():
    left = {"ids": b"\0" * 8, "tail": [{"at": 5, "n": 1}], "head": []}
    right = {"ids": b"\0" * 8, "tail": [], "head": [{"at": 4, "n": 0}, {"at": 6, "n": 1}]}
    with pytest.raises(ValueError, match="share no boundary"):
        byte_bpe.stitched([left, right])


@pytest.mark.parametrize("chunk, overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (12, 2)])
def test_encode_and_decode(spark, awkward, empty, library, chunk, overlap):
    docs = awkward if chunk > 100 else awkward.withColumn("text", F.substring("text", 1, 3000))
    coded = byte_bpe.encode(docs, chunk=chunk, overlap=overlap)
    assert coded.columns == [*docs.columns, "ids"]
    rows = coded.withColumn("back", byte_bpe.decoder(spark, byte_bpe.RANKS)("ids")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
        assert (r.doc, r.key, r["n.x"]) == ("d", 1, 2)
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert byte_bpe.encode(empty).count() == 0


def test_bpe_report(awkward, library):
    got = sorted((tuple(r) for r in byte_bpe.bpe_report(awkward).collect()), key=str)
    want = []
    for r in awkward.collect():
        ids = library.encode_ordinary(r.text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r.text or "").encode())))
    assert got == sorted(want, key=str)


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([64, -5, None, 10**6, 65],)], "ids array<int>")
    assert [r[0] and bytes(r[0]) for r in rows.select(byte_bpe.decoder(spark)("ids")).collect()] == [None, b"", b"ab"]


# ---- fill in middle ------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(text, h):
    text = text or ""
    t = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(t), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def drawn(doc_id):
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_displacements_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    turn = random.Random(block)
    letters = ["a", "é", "😀", " ", "\n", "\x0b", "<", "P", ">", "S", "M", "<S", "P>"]
    for _ in range(80):
        texts = [None if turn.random() < 0.1 else "".join(turn.choice(letters) for _ in range(turn.randint(0, 25))) for _ in range(turn.randint(0, 9))]
        h = np.array([[turn.randrange(1 << 32) for _ in range(4)] for _ in texts], np.int64).reshape(-1, 4)
        made = fill_middle.transform(pa.array(["first", "<S>", *texts], pa.string()).slice(2), h)
        assert [tuple(x.values()) for x in made.to_pylist()] == [brute_fim(t, x) for t, x in zip(texts, h.tolist())]
        assert fill_middle.inverse(made.field("output"), made.field("form")).to_pylist() == [t or "" for t in texts]


def test_malformed_outputs_restore_to_null():
    outputs = pa.array(["<P>a<S>b<M>c", "<S>a<P>b<M>c", "<P>a", "x<P>a<S>b<M>c", "<P>a<S>b<M>c", "<P>a", None])
    forms = pa.array(["psm", "spm", "psm", "psm", "spm", "plain", "plain"])
    assert fill_middle.inverse(outputs, forms).to_pylist() == ["acb", "bca", None, None, None, "<P>a", ""]


def test_fill_in_middle_on_awkward_rows(spark, frame, awkward, empty):
    docs = awkward.unionAll(frame([(i, f"some words <{'PSMX'[i % 4]}> here\nand  more {i} \t") for i in range(100, 140)]))
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim"]
    rows = made.withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == docs.count() and {r.fim.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r.fim) == brute_fim(r.text, drawn(r.doc_id)) and r.back == (r.text or "")
    assert fill_middle.fill_in_middle_report(empty).count() == 0
