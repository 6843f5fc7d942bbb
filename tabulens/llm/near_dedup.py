"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``width`` words (five unless asked otherwise; A-Z in lower case, words
``[^\\x20\\x09-\\x0D]+``; a shorter text is one shingle). Documents whose sets have a Jaccard similarity of ``SIMILARITY``
percent or more are linked; a component keeps its smallest id.

1. Each text becomes ``COORDS`` minwise tokens and a 128-bit sketch of them. Equal sets fall into one class, which goes on
   as its smallest id: groups of exact copies, however large, are one row from here on.
2. ``TREES`` independent trees branch the classes: a node picks one or two coordinates (1 / similarity on average, so that
   the number of nodes two similar sets share does not shrink with depth), and a set goes to the child named by its token.
3. In every node the smallest id is compared with all others. Candidates that pass the sketch and the size ratio are
   confirmed on full sets, and confirmed links are contracted to components.
4. Sets of a node that are in one component need no further comparison. What is left of small nodes is compared
   exhaustively, large nodes that still mix components branch further. What is large after the last of ``DEPTHS`` is
   compared as full sets in blocks: those outside the largest component with all. Nothing is capped.

Two sets with similarity of exactly 0.8 meet in a given tree with probability 0.64 at depth 3 and 0.44 at depth 7, so all
``TREES`` miss them with 5e-6 and 1e-3; closer pairs are missed far less. Sketches cut pairs at five standard deviations.

Ids of one node or component never gather in a task: minima are pre-aggregated, joins leave room for adaptive splitting,
and comparisons are dealt in groups of at most ``GROUP`` partners.

Edge cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing. A single word is
a set of one. Rows with one id and several texts: each row is reported by its own text, and when copies are dropped all rows of
the id go if one does. A row with a null id takes no part and stays. An empty table gives an empty one. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, small_batches, utf8
from tabulens.session import materialized

WIDTH = 5
SIMILARITY = 80
COORDS = 64
TREES = 12
DEPTHS = (3, 7)
SMALL = 64
GROUP = 256
#: A table of candidate ids is broadcast to the scan of the texts up to this many rows (about 30 MB); beyond, both are shuffled.
BROADCAST_ROWS = 500_000
#: Of 64 two-bit fields, so many may differ: 40 agree in pairs of similarity 0.8 but for one in a million.
SKETCH_DIFF = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20_177)
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
_SHIFTS = (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def shingles(words: list[bytes], width: int) -> set:
    """The exact set that links are confirmed on."""
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def hashed_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    many = max(1, len(h) - width + 1)
    out = np.full(many if len(h) else 0, np.uint64(min(len(h), width)))
    for i in range(min(len(h), width)):
        out = _mix(out * _ODD + h[i : i + many])
    return np.unique(out)


def minwise(items: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.uint64(2**64 - 1))
    for i in range(0, len(items), 4096):
        low = np.minimum(low, (items[i : i + 4096][None, :] * _MUL[:, None] + _ADD[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _signing(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1):
                items = hashed_set(words_of(text.as_py()), width, hashes)
                sizes.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                sigs.append(minwise(items).astype("<u4").tobytes() if len(items) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc", "size", "set_key", "sig"])

    return sign


def signatures(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc, size of its set, digest of the set, minwise tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(col(doc_id).cast("long").alias("doc"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(_signing(width), "doc long, size long, set_key binary, sig binary")


def _branch(seeds: np.ndarray, rows: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes: one coordinate for each node, and a second one for every fourth."""
    pick = _mix(seeds ^ np.uint64(0xA5A5A5A5))
    first = (pick % np.uint64(COORDS)).astype(np.int64)
    more = (pick >> np.uint64(20)) % np.uint64(4) == 0
    second = (first + 1 + ((pick >> np.uint64(30)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS

    def child(at: np.ndarray, coord: np.ndarray) -> np.ndarray:
        return _mix(seeds[at] * _ODD + (coord[at].astype(np.uint64) << np.uint64(32)) + sigs[rows[at], coord[at]].astype(np.uint64))

    every, some = np.arange(len(seeds)), np.flatnonzero(more)
    return np.concatenate([child(every, first), child(some, second)]), np.concatenate([rows, rows[some]])


def _nodes(steps: int, rooted: bool):
    """Rows (node, doc, size, sketch) for the nodes ``steps`` below the given ones, or below the roots of all trees."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(n, COORDS)
            rows = np.tile(np.arange(n), 1 if rooted else TREES)
            seeds = batch.column("node").to_numpy().astype(np.uint64) if rooted else np.repeat(_mix(np.arange(1, TREES + 1, dtype=np.uint64) * _ODD), n)
            for _ in range(steps):
                seeds, rows = _branch(seeds, rows, sigs)
            bits = (sigs & 3).astype(np.uint64)
            sketch = [(bits[:, i : i + 32] << _SHIFTS).sum(1, dtype=np.uint64).view(np.int64)[rows] for i in (0, 32)]
            yield pa.RecordBatch.from_pydict({
                "node": seeds.view(np.int64), "doc": batch.column("doc").to_numpy()[rows], "size": batch.column("size").to_numpy()[rows],
                "s1": sketch[0], "s2": sketch[1],
            })

    return grow


_NODE_ROWS = "node long, doc long, size long, s1 long, s2 long"


def alike(a: Column, b: Column) -> Column:
    """Whether two members (size, s1, s2) may be similar: sizes bound the similarity, sketches estimate it."""

    def differ(name: str) -> Column:
        x = a[name].bitwiseXOR(b[name])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    sizes = (a["size"] * 100 >= b["size"] * SIMILARITY) & (b["size"] * 100 >= a["size"] * SIMILARITY)
    return sizes & (differ("s1") + differ("s2") <= SKETCH_DIFF)


def _confirming(width: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, the hub's texts first: compares each partner with the hub on full sets."""
        here, hubs = None, []
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for g, a, doc, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (g, a) != here:
                    here, hubs = (g, a), []
                own = shingles(words_of(text.as_py()), width)
                if not member:
                    hubs.append(own)
                elif any(100 * (both := len(own & other)) >= SIMILARITY * (len(own) + len(other) - both) and both for other in hubs):
                    found[0].append(a)
                    found[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return confirm


def _with_texts(need: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of need, which has a column doc, with the texts."""
    need = materialized(need, "need")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    return docs.select(col(doc_id).cast("long").alias("doc"), col(text).cast("string").alias("text")).join(need, "doc")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar. Each text travels once for each group it is in."""
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)))
    salted = salted.withColumn("g", F.xxhash64("a", "part"))
    hubs = salted.select("g", "a").distinct().select("g", "a", F.col("a").alias("doc"), F.lit(False).alias("member"))
    need = salted.select("g", "a", F.col("b").alias("doc"), F.lit(True).alias("member")).unionByName(hubs)
    texts = _with_texts(need, docs, doc_id, text)
    dealt = texts.select("g", "a", "doc", "member", "text").repartition("g").sortWithinPartitions("g", "a", "member")
    return dealt.mapInArrow(_confirming(width), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc, label for every id in the links (a, b): the smallest id reachable. Minimum labels with pointer jumping."""
    both = materialized(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))), "links")
    labels = materialized(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("doc"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("low"))
        hooked = labels.join(near.withColumnRenamed("x", "doc"), "doc").select("doc", F.least("label", "low").alias("label"), F.col("label").alias("before"))
        up = labels.select(F.col("doc").alias("label"), F.col("label").alias("above"))
        now = materialized(hooked.join(up, "label").select("doc", F.least("label", "above").alias("label"), "before"), "labels")
        labels = now.select("doc", "label")
        if now.where("label <> before").isEmpty():
            return labels


def _comparing(width: int):
    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one cell (x, y, or both on either side) whose hashed sets are similar and whose labels differ."""
        hashes = WordHashes()
        sets = [hashed_set(words_of(t), width, hashes) for t in cell["text"]]
        sizes, label, doc = np.array(list(map(len, sets))), cell["label"].to_numpy(), cell["doc"].to_numpy()
        x, y = np.flatnonzero(cell["left"]), np.flatnonzero(~cell["left"])
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        # Items that both sides hold, as columns of one matrix for each side, so many columns at a time.
        shared = np.intersect1d(np.concatenate([sets[i] for i in x]), np.concatenate([sets[i] for i in y]))
        both = np.zeros((len(x), len(y)), np.float32)
        for start in range(0, len(shared), 4096):
            items = shared[start : start + 4096]

            def rows(side: np.ndarray) -> np.ndarray:
                out = np.zeros((len(side), len(items)), np.float32)
                for r, i in enumerate(side):
                    mine = sets[i]
                    out[r, np.searchsorted(items, mine[np.isin(mine, items)])] = 1
                return out

            both += rows(x) @ rows(y).T
        union = sizes[x][:, None] + sizes[y][None, :] - both
        r, c = np.nonzero((100 * both >= SIMILARITY * union) & (both > 0) & (label[x][:, None] != label[y][None, :]))
        return pd.DataFrame({"a": doc[x[r]], "b": doc[y[c]]})

    return compare


def _families(large: DataFrame) -> DataFrame:
    """doc, label, family for the documents of nodes that stayed large: nodes with a document in common are one family."""
    low = large.groupBy("node").agg(F.min("doc").alias("a"))
    families = components(large.join(low, "node").select("a", F.col("doc").alias("b")).distinct()).withColumnRenamed("label", "family")
    return materialized(large.select("doc", "label").distinct().join(families, "doc"), "families")


def _between_families(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """The pairs that are not within one family."""
    for side in ("a", "b"):
        pairs = pairs.join(families.select(F.col("doc").alias(side), F.col("family").alias(f"of_{side}")), side, "left")
    return pairs.where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b")


def _apart_in_families(members: DataFrame, docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Similar pairs (a, b) between components of a family, found by comparing sets in blocks.

    The documents outside its largest component are compared with all, in cells of at most ``GROUP`` documents on a side.
    """
    main = members.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    sizes = members.join(main, "family").groupBy("family").agg(
        F.first("main").alias("main"), F.ceil(F.count("*") / GROUP).alias("ys"), F.ceil(F.count_if(F.col("label") != F.col("main")) / GROUP).alias("xs"),
    )
    placed = members.join(sizes, "family")
    xs, ys = F.sequence(F.lit(0).cast("long"), F.col("xs") - 1), F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)
    here = placed.where(F.col("label") != F.col("main")).select("family", "doc", "label", F.lit(True).alias("left"), F.pmod(F.xxhash64("doc"), "xs").alias("xb"), F.explode(ys).alias("yb"))
    there = placed.select("family", "doc", "label", F.lit(False).alias("left"), F.explode(xs).alias("xb"), F.pmod(F.xxhash64("doc"), "ys").alias("yb"))
    texts = _with_texts(here.unionByName(there), docs, doc_id, text)
    return texts.groupBy("family", "xb", "yb").applyInPandas(_comparing(width), "a long, b long").distinct()


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of components with more links: only links between components are looked at, as links of their labels."""
    if labels is None:
        return components(links)
    ends, outer = links, ("a", "b")
    for side in outer:
        ends = ends.join(labels.select(F.col("doc").alias(side), F.col("label").alias(f"of_{side}")), side, "left")
    ends = materialized(ends.select("a", "b", *(F.coalesce(f"of_{x}", x).alias(f"of_{x}") for x in outer)), "ends")
    between = ends.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    joined = components(between).select(F.col("doc").alias("label"), F.col("label").alias("low"))
    fresh = ends.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(labels, "doc", "left_anti").withColumn("label", F.col("doc"))
    return materialized(labels.unionByName(fresh).join(joined, "label", "left").select("doc", F.coalesce("low", "label").alias("label")), "labels")


def near_components(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, size, component for every row of docs."""
    sigs = materialized(signatures(docs, width, doc_id, text), "signatures")
    classes = sigs.where("doc IS NOT NULL AND size > 0").groupBy("set_key").agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = materialized(classes, "classes")
    labels: DataFrame | None = None
    links: DataFrame | None = None  # confirmed, and not in the labels yet
    tested: DataFrame | None = None
    rows = classes.select("doc", "size", "sig").mapInArrow(_nodes(DEPTHS[0], False), _NODE_ROWS)
    for level, depth in enumerate(DEPTHS):
        pivots = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc", "size", "s1", "s2")).alias("pivot")).where("n > 1")
        members = materialized(rows.join(pivots, "node").withColumn("near", alike(F.col("pivot"), F.struct("size", "s1", "s2"))), "members")

        def try_pairs(pairs: DataFrame) -> None:
            nonlocal links, tested
            pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = materialized(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if not pairs.isEmpty():
                found = materialized(confirmed(pairs, docs, width, doc_id, text), "found")
                links = found if links is None else links.unionByName(found)

        def settle() -> None:
            nonlocal links, labels
            if links is not None:
                labels, links = merged(labels, links), None

        def apart(pairs: DataFrame) -> DataFrame:
            """The pairs that no confirmed links connect yet."""
            if labels is None:
                return pairs
            for side in ("a", "b"):
                pairs = pairs.join(labels.select(F.col("doc").alias(side), F.col("label").alias(f"of_{side}")), side, "left")
            return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

        # Each set first meets the smallest id of all its nodes, which settles most, and then the others.
        star = members.where("near").select(F.col("pivot.doc").alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()
        star = materialized(star, "star")
        try_pairs(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        settle()
        try_pairs(apart(star))
        settle()
        named = members.select("node", "doc", "size", "s1", "s2", "n")
        named = named.withColumn("label", F.col("doc")) if labels is None else named.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        one = F.struct("doc", "size", "s1", "s2", "label")
        small = named.where(F.col("n") <= SMALL).groupBy("node").agg(F.collect_list(one).alias("m"))
        unlinked = F.flatten(F.transform("m", lambda x: F.transform(
            F.filter("m", lambda y: (y["doc"] > x["doc"]) & (y["label"] != x["label"]) & alike(x, y)), lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b")),
        )))
        left = small.where(F.size("m") > 1).select(F.explode(unlinked).alias("p")).select("p.*")
        large = named.where(F.col("n") > SMALL)
        mixed = large.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node")
        large = materialized(large.join(mixed, "node"), "large")
        more = not large.isEmpty()
        if more and level == len(DEPTHS) - 1:
            families = _families(large)
            left = _between_families(left, families).unionByName(_apart_in_families(families, docs, width, doc_id, text))
        try_pairs(left)
        if not more or level == len(DEPTHS) - 1:
            settle()
            break
        deeper = large.select("node", "doc").join(classes.select("doc", "size", "sig"), "doc")
        rows = deeper.mapInArrow(_nodes(DEPTHS[level + 1] - depth, True), _NODE_ROWS)
    of_class = classes.select("set_key", F.col("doc").alias("class"))
    if labels is not None:
        of_class = of_class.join(labels.withColumnRenamed("doc", "class"), "class", "left").select("set_key", F.coalesce("label", "class").alias("class"))
    out = sigs.select("doc", "size", "set_key").join(of_class, "set_key", "left")
    return out.select("doc", "size", F.when(F.col("doc").isNotNull(), F.coalesce("class", "doc")).alias("component"))


def near_report(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    found = near_components(docs, width, doc_id, text)
    return found.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, with their columns as they were."""
    gone = near_components(docs, width, doc_id, text).where("doc <> component").select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, col(doc_id).cast("long") == F.col("__gone"), "left_anti")
