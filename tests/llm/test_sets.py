"""Line dedup, near-dedup, mixing, nearest vectors, the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import line_dedup, mixing, near_dedup, vector_codes
from tabulens.llm.line_dedup import CuckooFilter, LineIndex

# ---- line dedup ----------------------------------------------------------------------------------


def digests(n, tag=""):
    return np.array([hashlib.blake2b(f"{tag}{i}".encode(), digest_size=16).digest() for i in range(n)], dtype=object)


def test_cuckoo_filter_adds_and_deletes():
    keys, others = digests(5000), digests(5000, "x")
    held = CuckooFilter.loads(CuckooFilter.over(keys).dumps())
    assert held.holds(keys).all() and held.holds(others).mean() < 0.01
    held.drop(keys[:2500])
    assert held.holds(keys[2500:]).all() and held.holds(keys[:2500]).mean() < 0.01
    assert not CuckooFilter.over(keys[:0]).holds(keys[:3]).any()


def brute_lines(rows):
    keys = lambda t: [line_dedup.key_of(x.encode()) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if k and i is not None:
                holders[k].add(i)
    out = []
    for i, t in rows:
        gone = [k is not None and i is not None and len(holders[k]) > 1 and i != min(holders[k]) for k in keys(t)]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)
        out.append((i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(n, seed):
    turn = random.Random(seed)
    lines = [f"Line number {i % 37} of many " for i in range(60)] + ["short", "", "  LINE number 3 of many", "éééééééééé"]
    return [(i, "\n".join(turn.choice(lines) for _ in range(turn.randint(0, 6)))) for i in range(n)]


def reported(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines_by_brute_force(frame, awkward, empty):
    rows = line_rows(80, 1)
    assert reported(line_dedup.line_report(frame(rows))) == brute_lines(rows)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert reported(line_dedup.line_report(awkward)) == brute_lines(rows)
    assert line_dedup.line_report(empty).count() == 0


def test_insertions_and_removals_are_reversible(spark, frame):
    rows = line_rows(90, 2)
    index = LineIndex(spark)
    for part in (rows[30:60], rows[:30], rows[60:]):
        index.insert(frame(part))
    report = lambda docs: reported(index.clean(docs).select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.text", 256)))
    assert report(frame(rows)) == brute_lines(rows)
    index.remove(frame(rows[:20]).select("doc_id"))
    assert report(frame(rows[20:])) == brute_lines(rows[20:])
    index.insert(frame(rows[:20]))
    assert report(frame(rows)) == brute_lines(rows)
    fresh = LineIndex(spark).insert(frame(rows))
    assert reported(index.counts().select("key", "n_refs", "first", "last")) == reported(fresh.counts().select("key", "n_refs", "first", "last"))


def test_filters_know_every_held_key(spark, frame):
    index = LineIndex(spark).insert(frame(line_rows(40, 3)))
    assert index._probed(index.counts().select("shard", "key")).where("NOT known").count() == 0


def test_dropped_lines_keep_columns(awkward):
    out = line_dedup.drop_repeated_lines(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where("doc_id = 3 AND text IS NULL").count() == 1


# ---- near-dedup ----------------------------------------------------------------------------------


def brute_components(rows, width):
    sets = [(i, near_dedup.shingles(near_dedup.words_of(t), width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(x), find(i)) for i, x in sets}


def copies(n, seed, words=60):
    """Families around a base text: from exact copies to texts just over or under the threshold."""
    turn, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[turn.choice(vocabulary) for _ in range(words)] for _ in range(max(1, n // 40))]
    for i in range(n):
        text = list(turn.choice(bases))
        for _ in range(turn.choice([0, 0, 1, 2, 3, 4, 6, 8])):
            text[turn.randrange(len(text))] = turn.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_by_brute_force(frame, width):
    rows = copies(300, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_report(frame(rows), width).collect()}
    assert got == brute_components(rows, width)


def test_large_mixed_families_are_compared_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rows = copies(160, 11, 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_report(frame(rows), 2).collect()}
    assert got == brute_components(rows, 2)


def test_near_dedup_on_awkward_rows(awkward, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_report(awkward, 2).collect()}
    assert {(1, 14, 1), (2, 14, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (9, 1, 8)} <= got
    assert (None, 14, None) in got and (None, 0, None) in got
    kept = near_dedup.drop_near_copies(awkward, 2)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 8, 10]
    assert near_dedup.near_report(empty).count() == 0 and near_dedup.drop_near_copies(empty).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 120)] + [(500, 501), (501, 700), (3, 90)]
    got = {r.doc: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(121)) and {got[500], got[501], got[700]} == {500}


# ---- mixing --------------------------------------------------------------------------------------


def brute_schedule(a, n):
    """Earliest deadline first, slot by slot, over the whole mix; a share is a[i] of the sum."""
    m, done, order = sum(a), [0] * len(a), []
    for t in range(n):
        due, pick = min((-(-(done[i] + 1) * m // x), i) for i, x in enumerate(a) if done[i] * m // x <= t)
        assert due > t
        done[pick] += 1
        order.append((pick, done[pick] - 1))
        assert all(abs(done[i] - Fraction((t + 1) * x, m)) < 1 for i, x in enumerate(a))
    return order


@pytest.mark.parametrize("shares", [[1], [500, 10, 10, 10, 470], [7, 3, 5, 1, 1, 1], [333, 333, 334], [1] * 40 + [60], [90_000, 7, 7, 7, 9_000, 1, 1, 1, 1]])
@pytest.mark.parametrize("length", [9, 50])
def test_schedule_by_brute_force(spark, shares, length):
    names = [f"s{i:03}" for i in range(len(shares))]
    line = spark.createDataFrame([([(x, 10, a) for x, a in zip(names, shares)],)], "v array<struct<src: string, n: long, a: long>>")
    turns = mixing.earliest_deadline_first(mixing.waiting(line, sum(shares), 12, length), sum(shares), length)
    got = {slot: (r.src, r.first + j) for r in turns.collect() for j, slot in enumerate(r.slots)}
    assert got == {t: (names[i], k) for t, (i, k) in enumerate(brute_schedule(shares, 12 * length))}


def test_mix_keeps_every_row_and_its_shares(frame, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    docs = frame([(i, f"t{i}", "abc"[0 if i % 3 else 1 + i % 2]) for i in range(1500)])
    rows = mixing.mixed(docs, {"a": 5, "b": 3, "c": 2, "absent": 9}, block=4, period=100).orderBy("__position").collect()
    assert {r.doc_id for r in rows} == set(range(1500)) and len({r["__position"] for r in rows}) == len(rows)
    assert all(r["__epoch"] < mixing.MAX_EPOCHS for r in rows)
    blocks = [next(iter(s)) for s in (lambda d: [d[k] for k in sorted(d)])(_by_slot(rows)) if len(s) == 1]
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    for t in range(1, len(blocks) + 1):
        count = Counter(blocks[:t])
        assert all(abs(count[s] - w * t) < 1 for s, w in share.items())


def _by_slot(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["__slot"]].add(r.source)
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 0.5, "b": 0.4999, "c": 0.0001}, {f"s{i:03}": 1 + i % 7 + i / 31 for i in range(150)}])
def test_blocks_follow_unrounded_weights(spark, weights):
    total = sum(Fraction(w) for w in weights.values())
    counts = spark.createDataFrame([(s, 1 if w / float(total) < 0.01 and len(weights) < 9 else 8000 // len(weights), float(w)) for s, w in weights.items()], "src string, n long, w double")
    placed = mixing.schedule(counts, 100, 1).orderBy("slot").collect()
    assert [r.slot for r in placed] == list(range(len(placed))) and len(placed) > 5000
    done, share = Counter(), {s: float(Fraction(w) / total) for s, w in weights.items()}
    for t, r in enumerate(placed, 1):
        assert r.block == done[r.src]
        done[r.src] += 1
        assert all(abs(done[s] - w * t) < 1 for s, w in share.items())


def test_no_row_comes_twice_in_an_epoch(frame):
    docs = frame([(i, "t", "ab"[i % 2] if i < 800 else f"small{i % 50:02}") for i in range(1050)])
    for weights in (None, {"a": 9, "b": 3} | {f"small{i:02}": 10.0 ** -(i % 3) for i in range(50)}):
        rows = mixing.mixed(docs, weights, period=20, block=2).collect()
        assert {r.doc_id for r in rows} == set(range(1050))
        assert len({(r.doc_id, r["__epoch"]) for r in rows}) == len(rows) == len({r["__position"] for r in rows})


def test_small_sources_reach_their_share(frame):
    docs = frame([(i, "t", "small" if i < 8 else "large") for i in range(808)])
    weights = {"small": 1, "large": 1}
    got = {r.src: r.share for r in mixing.shares_reached(mixing.mixed(docs, weights, block=4)).collect()}
    assert abs(got["=small"] - 0.5) < 0.01
    rows = mixing.mixed(docs, weights, block=4, max_epochs=5).collect()
    assert {r.doc_id for r in rows} == set(range(808)) and max(Counter(r.doc_id for r in rows).values()) == 5
    assert max(r["__slot"] for r in rows) < 215


def test_mix_of_awkward_rows(awkward, empty):
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in awkward.collect()}
    assert mixing.mix(empty).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(awkward, {"s": 1.0}).count()


# ---- nearest vectors -----------------------------------------------------------------------------


def brute_nearest(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = x @ q
            ranked = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]
            out[i] = [j for _, j in ranked]
    return out


@pytest.mark.parametrize("d, spread", [(64, 0.0), (17, 3.0), (1, 1.0)])
def test_recall_against_brute_force(spark, monkeypatch, d, spread):
    monkeypatch.setattr(vector_codes, "ROW_BLOCK", 300)
    monkeypatch.setattr(vector_codes, "QUERY_BLOCK", 16)
    turn = np.random.default_rng(d)
    x = turn.standard_normal((1000, d)) * np.exp(spread * turn.standard_normal((1000, 1)))
    ids = turn.permutation(5000)[:1000]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vector_codes.nearest_vectors(df, 20, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(ids, x, 20, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, []), (20, [1.0, 2.0, 3.0]), (40, [1e-200, 1e200])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, d string")
    got = [(r.query_id, r.rank, r.vec_id) for r in vector_codes.nearest_vectors(df).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 40), (0, 4, 3)]
    assert not [g for g in got if g[0] == 20] and len([g for g in got if g[0] == 40]) == 4
    assert vector_codes.nearest_vectors(df.limit(0)).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline
    from tabulens.llm import quality_rules, sentencepiece_codec

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialized(stage(spark, docs, data), "stage")
        seen.append(docs.toPandas())
    assert all(list(s.columns) == list(seen[0].columns) for s in seen[:-1])
    ruled = [i for i, t in zip(seen[0].doc_id, seen[0].text) if not any(r.rejects(quality_rules.Facts(t)) for r in quality_rules.RULES)]
    assert sorted(seen[1].doc_id) == sorted(ruled)
    cleaned = dict(zip(seen[2].doc_id, seen[2].text))
    for i, _, _, digest in brute_lines(list(zip(seen[1].doc_id, seen[1].text))):
        assert hashlib.sha256(cleaned[i].encode()).hexdigest() == digest
    alike = brute_components(list(zip(seen[2].doc_id, seen[2].text)), 5)
    assert sorted(seen[3].doc_id) == sorted(i for i, (_, c) in alike.items() if i == c)
    assert set(seen[4].doc_id) == set(seen[3].doc_id) and seen[4].doc_id.value_counts().max() <= 4
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load())
    assert all(codec.decode(list(t)) == x for t, x in zip(seen[5].tokens, seen[5].text)) and len(seen[5]) == len(seen[4])
