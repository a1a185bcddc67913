"""One document of each group of near copies: SimHash fingerprints compared in tiles, links confirmed by the exact Jaccard similarity of word shingles.

Texts with equal words are one node, so exact copies cost nothing. Documents with a similarity of 0.8 differ in some ten of 64 bits, a radius within which
most pairs of unrelated fingerprints of a large corpus would have to be compared. So a tile holds the fingerprints that share a MinHash band;
of two texts with a similarity of 0.8 one in 1500 shares none of the 24 bands of 6. Inside a tile, and between the tiles of a band that is common, all
fingerprints are compared in full, but for tiles whose numbers of ones differ by more than the radius.

A comparison sends a spanning forest of the smallest distances within the radius, at most one link per fingerprint however large a group is. All texts that could be
linked are then in one component of these links. Inside a component, pairs within the radius are confirmed on the whole sets of shingles, the nearest first, unless
they are connected already. A large component is dealt to many tasks; the text with most links goes to all of them, so that tasks mostly agree without being compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import spark_schema, written as cut
from clearway.llm.components import components
from clearway.llm.simhash import bits_of_majority, words_of

SHINGLE = 5
SIMILARITY = 0.8
# Two texts at the similarity differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 20
BANDS, ROWS = 24, 6
TILE = 2048
# Texts of a component, and bytes of their sets of shingles, that one task holds, twice if it compares with another's.
GROUP_TEXTS, GROUP_BYTES = 512, 16 << 20
# Shingles whose MinHash values are computed at once; bounds the memory a long text needs.
SLICE = 4096
# Fixed by a rule: odd multipliers and shifts of the MinHash functions.
_STATE = np.random.RandomState(42)
_FACTORS = (_STATE.randint(1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _STATE.randint(1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64)

LONG = pa.int64()
SKETCH = pa.schema([("id", LONG), ("h", LONG), ("node", LONG), ("print", LONG), ("bands", pa.list_(LONG))])
SETS = pa.schema([("component", LONG), ("node", LONG), ("print", LONG), ("shingles", pa.binary())])
LINKS = pa.schema([("a", LONG), ("b", LONG)])


def shingle_hashes(text: str, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """64-bit hashes of all word shingles, repeats included, and the hash of all words; a text of fewer words is one shingle, without words none."""
    words = words_of(text)
    whole = xxhash.xxh64_intdigest(b" ".join(words))
    if len(words) < shingle:
        return np.array([whole] if words else [], dtype=np.uint64), whole
    known: dict[bytes, int] = {}
    coded = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], dtype=np.uint64)
    n = len(words) - shingle + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        mixed = (mixed ^ coded[k: n + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32)), whole


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(distinct), SLICE):
        values = distinct[None, at: at + SLICE] * _FACTORS[:, None] + _SHIFTS[:, None]
        # The high bits of a product are the well mixed ones.
        np.minimum(least, values.min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """Of rows (id, h, text): the node (hash of the words), fingerprint and band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, prints, bands = [], [], []
                for text in part["text"].to_pylist():
                    shingles, whole = shingle_hashes(text)
                    nodes.append(whole)
                    prints.append(bits_of_majority(shingles))
                    bands.append(band_keys(np.unique(shingles)))
                columns = [np.array(c, dtype=np.uint64).view(np.int64) for c in (nodes, prints)]
                yield pa.RecordBatch.from_arrays([part["id"], part["h"], *map(pa.array, columns), pa.array(bands, pa.list_(LONG))], schema=SKETCH)

    return rows.mapInArrow(run, spark_schema(SKETCH))


def distances(a: np.ndarray, other: np.ndarray, label: np.ndarray, other_label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hamming distances of 256 rows at a time to all others; 255 between rows of one group."""
    for at in range(0, len(a), 256):
        bits = np.bitwise_count(a[at: at + 256, None] ^ other[None, :])
        bits[label[at: at + 256, None] == other_label[None, :]] = 255
        yield at, bits


def forest_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of smallest Hamming distances within ``radius``, between rows of two tiles or inside one.

    Returns places in both tiles, one after the other. Every round each connected part takes its nearest link to another, so the parts at least halve in number.
    """
    both = a if b is None else np.concatenate([a, b])
    label = np.arange(len(both))
    shift, other = (0, a) if b is None else (len(a), b)
    links: list[tuple[int, int]] = []
    while True:
        distance = np.full(len(both), radius + 1, dtype=np.int64)
        partner = np.zeros(len(both), dtype=np.int64)
        for at, bits in distances(a, other, label[: len(a)], label[shift: shift + len(other)]):
            here = np.arange(at, at + len(bits))
            nearest = bits.argmin(axis=1)
            distance[here] = bits[here - at, nearest]
            partner[here] = nearest + shift
            if b is not None:
                nearest = bits.argmin(axis=0)
                least = bits[nearest, np.arange(len(other))]
                better = np.flatnonzero(least < distance[shift:])
                distance[shift + better] = least[better]
                partner[shift + better] = at + nearest[better]
        found = np.flatnonzero(distance <= radius)
        if not len(found):
            return links
        # The nearest link of each part; later ones of a round may have been connected by earlier ones.
        order = found[np.argsort(distance[found], kind="stable")]
        _, first = np.unique(label[order], return_index=True)
        for i in order[np.sort(first)].tolist():
            j = int(partner[i])
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]


def confirmed_links(a: np.ndarray, b: np.ndarray | None, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of two tiles, or inside one, whose sets are similar enough, as far as they connect something new; rows of one ``label`` are connected."""
    _, group = np.unique(label, return_inverse=True)
    shift, other = (0, a) if b is None else (len(a), b)
    found = []
    for at, bits in distances(a, other, group[: len(a)], group[shift: shift + len(other)]):
        i, j = np.nonzero(bits <= radius)
        near = bits[i, j].astype(np.int64)
        i, j = i + at, j + shift
        keep = i < j
        found.append(np.stack([near[keep], i[keep], j[keep]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    parent = list(range(int(group.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    numbers = group.tolist()
    for i, j in zip(*(pairs[k, np.argsort(pairs[0], kind="stable")].tolist() for k in (1, 2))):
        x, y = root(numbers[i]), root(numbers[j])
        if x != y and similar(sets[i], sets[j], similarity):
            parent[y] = x
            links.append((i, j))
    return links


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    # Sets of too different sizes need no comparison.
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and common >= similarity * (len(both) - common) - 1e-9


def tiles_of(nodes: DataFrame, tile: int) -> DataFrame:
    """Nodes (node, print, bands) that share a band with others, as tiles of at most about ``tile`` rows: band, cut, rows and their numbers of ones."""
    banded = nodes.select(F.explode("bands").alias("band"), "node", "print")
    shared = banded.groupBy("band").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = banded.join(shared, "band").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    ones = F.bit_count("print")
    return cut(dealt.groupBy("band", "cuts", "cut").agg(
        F.sort_array(F.collect_list(F.struct("node", "print"))).alias("rows"), F.min(ones).alias("least"), F.max(ones).alias("most")))


def candidate_links(tiles: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all nodes of ``tiles`` which share a band and differ in at most ``radius`` bits."""
    inside = tiles.select("rows", F.lit(None).cast(dict(tiles.dtypes)["rows"]).alias("rows2"))
    many = tiles.where("cuts > 1")
    other = many.select("band", *[F.col(c).alias(f"{c}2") for c in ("cut", "rows", "least", "most")])
    near = (F.col("least") - F.col("most2") <= radius) & (F.col("least2") - F.col("most") <= radius)
    between = many.join(other, "band").where((F.col("cut") < F.col("cut2")) & near).select("rows", "rows2")

    def links(a: pa.Array, b: pa.Array | None) -> list[tuple[int, int]]:
        prints = [x.field("print").to_numpy().view(np.uint64) for x in (a, b) if x is not None]
        if b is None and len(a) == 2:
            return [(0, 1)] if int(prints[0][0] ^ prints[0][1]).bit_count() <= radius else []
        return forest_links(prints[0], prints[1] if b is not None else None, radius)

    return inside.unionByName(between).mapInArrow(_linking(links), spark_schema(LINKS)).distinct()


def _linking(links):
    """A ``mapInArrow`` function over columns rows and rows2 (or null): calls ``links`` on both and returns the nodes of the places it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.zeros((0, 2), dtype=np.int64)]
            for rows, rows2 in zip(batch["rows"], batch["rows2"]):
                a, b = rows.values, rows2.values if rows2.is_valid else None
                if found := links(a, b):
                    node = a.field("node").to_numpy() if b is None else np.concatenate([a.field("node").to_numpy(), b.field("node").to_numpy()])
                    ends.append(np.sort(node[np.array(found)], axis=1))
            ends = np.concatenate(ends)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=LINKS)

    return run


def confirmed_groups(links: DataFrame, named: DataFrame, sets: DataFrame, radius: int, similarity: float, texts: int) -> DataFrame:
    """(node, component) over all pairs of ``sets`` (component, node, print, shingles) in one component of ``links`` that are near and similar enough.

    ``named`` are the components (node, component) of the links. A node may have several equal rows.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().join(named, "node")
    members = sets.select("component", F.struct("node", "print", "shingles").alias("r"))
    # As many parts of a component as its texts need; the text with most links is in all of them.
    sizes = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / texts, F.sum(F.length("r.shingles")) / GROUP_BYTES)).cast("int").alias("cuts"))
    hubs = ends.groupBy("component").agg(F.max_by("node", F.struct("count", "node")).alias("hub"))
    parts = F.when(F.col("r.node") == F.col("hub"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("r.node"), F.col("cuts")).cast("int")))
    dealt = members.join(sizes.join(hubs, "component"), "component").select("component", "cuts", F.explode(parts).alias("cut"), "r")
    tiles = cut(dealt.groupBy("component", "cuts", "cut").agg(F.collect_list("r").alias("rows")))

    def confirming(a: pa.Array, b: pa.Array | None) -> list[tuple[int, int]]:
        sides = [a] if b is None else [a, b]
        prints = [x.field("print").to_numpy().view(np.uint64) for x in sides] + [None]
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for x in sides for v in x.field("shingles")]
        labels = [x.field("label" if b is not None else "node").to_numpy() for x in sides]
        return confirmed_links(prints[0], prints[1], np.concatenate(labels), sets, radius, similarity)

    def confirm(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select("rows", "rows2").mapInArrow(_linking(confirming), spark_schema(LINKS)))

    good = confirm(tiles.withColumn("rows2", F.lit(None).cast(dict(tiles.dtypes)["rows"])))
    many = tiles.where("cuts > 1")
    if not many.isEmpty():
        # Parts of one component whose texts are not all connected yet are compared with each other.
        known = components(good, cut).withColumnRenamed("component", "label")
        rows = many.select("component", "cut", F.explode("rows").alias("r")).select("component", "cut", "r.*").join(known, "node", "left")
        rows = rows.withColumn("label", F.coalesce("label", "node"))
        labelled = cut(rows.groupBy("component", "cut").agg(
            F.collect_list(F.struct("node", "print", "shingles", "label")).alias("rows"), F.min("label").alias("least"), F.max("label").alias("most")))
        other = labelled.select("component", *[F.col(c).alias(f"{c}2") for c in ("cut", "rows", "least", "most")])
        heads = labelled.drop("rows").join(other.drop("rows2"), "component").where("cut < cut2 and (least <> most2 or least2 <> most)")
        pairs = heads.select("component", "cut", "cut2").join(labelled.select("component", "cut", "rows"), ["component", "cut"]).join(
            other.select("component", "cut2", "rows2"), ["component", "cut2"])
        good = cut(good.unionByName(confirm(pairs)))
    return components(good, cut)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """Of rows (component, node, print, text): the sorted distinct shingles of each node, once per task whatever the rows of a node in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = []
                for n, node in enumerate(part["node"].to_pylist()):
                    if node not in done:
                        done.add(node)
                        new.append(n)
                part = part.take(pa.array(new, LONG))
                sets = [np.unique(shingle_hashes(t)[0]).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in ("component", "node", "print")], pa.array(sets, pa.binary())], schema=SETS)

    return rows.mapInArrow(run, spark_schema(SETS))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, h, rows, component, kept): the distinct ids and text hashes of ``docs``, how many rows have them, their group, and whether they stay.

    Of each group the smallest id stays (null ids last), of several texts with that id the one with the smallest hash.
    """
    rows = _rows(docs, id_col, text_col)
    found = cut(sketches(rows))
    # The first row of each node stands for it; copies are aggregated before they are shuffled.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("first")
    nodes = cut(found.groupBy("node").agg(first, F.first("print").alias("print"), F.first("bands").alias("bands")))
    links = cut(candidate_links(tiles_of(nodes, tile), radius))
    named = cut(components(links, cut))
    # Only texts with links are read again; of a node's texts one, by its id and hash. What a set needs later comes along, and rows of one id and
    # text are in one task after the join but for skew, so sets of shingles are shuffled once, by component.
    wanted = cut(named.join(nodes.select("node", "print", F.col("first.id").alias("id2"), F.col("first.h").alias("h2")), "node"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    sets = cut(shingle_sets(texts.select("component", "node", "print", "text")))
    confirmed = confirmed_groups(links, named, sets, radius, similarity, min(tile, GROUP_TEXTS))
    grouped = nodes.select("node", "first").join(confirmed, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    best = grouped.groupBy("component").agg(F.min("first").alias("best"))
    by_row = found.groupBy("node", "id", "h").agg(F.count("*").alias("rows"))
    out = by_row.join(grouped.select("node", "component"), "node").join(best, "component")
    return out.select("id", "h", "rows", "component", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))).alias("kept"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``.

    Texts are compared by their words with A-Z in lower case: those with equal words are one group, empty and null texts too; others are linked if their sets of
    five-word shingles (all words, if there are fewer) have a Jaccard similarity of at least ``similarity``. The smallest id of a group stays, a null id only if there is no other.
    Of rows with equal id and text one stays, whatever is in their other columns.
    """
    kept = cut(groups(docs, id_col, text_col, similarity).where("kept").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "rows"))
    # Names that no column of the documents has.
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(text) == kept["_h"]))
    own = [docs[c] for c in docs.columns]
    single = joined.where(kept["rows"] == 1).select(own)
    # Repeated rows are few or equal: one of each is taken by a combining aggregate.
    repeated = joined.where(kept["rows"] > 1).groupBy(kept["_id"], kept["_h"]).agg(F.first(F.struct(own)).alias("one")).select("one.*")
    return single.unionByName(repeated)
