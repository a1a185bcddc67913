import random

import numpy as np
import pytest

from brute import lowest_reachable
from clearway.llm import near_copies
from clearway.llm.simhash import words_of

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = words_of(text or "")
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows, similarity=0.8):
    """Row number -> smallest row number reachable over links between texts."""
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return lowest_reachable(range(len(rows)), links)


def edited_texts(seed, originals=12, copies=6, words=60):
    rng = random.Random(seed)
    texts = []
    for o in range(originals):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(words // 2, words * 3))]
        texts.append(" ".join(base))
        for _ in range(copies):
            changed = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(changed[rng.choice([0, 0, 3]):]))
    rng.shuffle(texts)
    return texts


def components(found):
    """Sets of (id, text hash) by component."""
    out = {}
    for r in found:
        out.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed,tile", [(1, 2048), (2, 3), (3, 16)])
def test_groups_equal_brute_force(spark, seed, tile):
    rows = list(enumerate(edited_texts(seed)))
    wanted = {}
    for n, low in brute(rows).items():
        wanted.setdefault(low, []).append(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = near_copies.groups(df, tile=tile).collect()
    assert components(found) == sorted(map(sorted, wanted.values()))
    assert {r.id for r in found if r.kept} == set(wanted)


def test_a_group_of_many_near_copies(spark):
    """Two thousand texts, each a word away from one original: one group, over many tiles, without a link per pair."""
    base = [f"w{n}" for n in range(300)]
    rows = [(n, " ".join(base[:k] + [f"x{n}"] + base[k + 1:])) for n, k in ((n, n * 7 % 300) for n in range(2000))]
    rows += [(5000 + n, " ".join(f"y{n}_{k}" for k in range(30))) for n in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(r.doc_id for r in near_copies.keep_one(df).collect())
    assert kept == [0, *range(5000, 5050)]
    nodes = near_copies.sketches(near_copies._rows(df, "doc_id", "text")).select("node", "print", "bands")
    assert near_copies.candidate_links(near_copies.tiles_of(nodes, 4000), near_copies.RADIUS).count() < 24 * 2000


def test_odd_rows(spark):
    rows = [
        (4, None, "a"), (3, "", "b"), (None, " ", "c"), (7, "Same words here", "d"), (6, "same  words HERE", "e"), (7, "Same words here", "f"),
        (None, "other words entirely", "g"), (None, "other words entirely", "h"), (9, "long " * 100_000, "i"), (10, "long " * 99_999, "j"),
        (1, "one id", "k"), (1, "one id", "l"), (1, "another text of that id which is quite different", "m"), (11, "same words there", "n"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", source string, rows long, component string")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or -1, " ".join((r.text or "").split())[:20]) for r in kept.collect())
    assert got == [(-1, "other words entirely"), (1, "another text of that"), (1, "one id"), (3, ""), (6, "same words HERE"), (9, "long long long long "), (11, "same words there")]
    assert near_copies.keep_one(df.limit(0)).collect() == []


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x", True), (2, "a b c d e f", 5, 6, "y", False)], SCHEMA + ", _id long, _h long, h string, kept boolean")
    kept = near_copies.keep_one(df).collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e f", 5, 6, "x", True)]


def test_links_of_tiles():
    rng = np.random.default_rng(4)
    for size in (2, 3, 40, 400):
        prints = rng.integers(0, 1 << 12, size=size, dtype=np.uint64)
        distance = lambda i, j: int(prints[i] ^ prints[j]).bit_count()
        for split in (None, size // 2):
            a, b = (prints, None) if split is None else (prints[:split], prints[split:])
            pairs = [(j, i) for i in range(size) for j in range(i) if distance(i, j) <= 3 and (split is None or j < split <= i)]
            links = near_copies.forest_links(a, b, 3)
            assert lowest_reachable(range(size), links) == lowest_reachable(range(size), pairs)
            # A forest of least total distance.
            group, total, wanted = list(range(size)), 0, 0
            for d, i, j in sorted((distance(i, j), i, j) for i, j in pairs):
                if group[i] != group[j]:
                    total, wanted = total + d, wanted + 1
                    group = [group[i] if x == group[j] else x for x in group]
            assert len(links) == wanted and sum(distance(i, j) for i, j in links) == total


@pytest.mark.parametrize("split", [None, 30])
def test_confirmed_links_connect_all_similar_sets(split):
    """Also where the nearest fingerprint belongs to a set that is not similar enough; rows of one label are connected already."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 60, size=100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 100)], rng.integers(1, 1 << 60, size=rng.integers(0, 9), dtype=np.uint64)])) for _ in range(70)]
    prints = rng.integers(0, 1 << 5, size=70, dtype=np.uint64)
    label = np.arange(70) % 66
    a, b = (prints, None) if split is None else (prints[:split], prints[split:])
    same = [(i, i - 66) for i in range(66, 70)]
    pairs = [
        (j, i) for i in range(70) for j in range(i) if (split is None or j < split <= i) and int(prints[i] ^ prints[j]).bit_count() <= 4
        and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    ]
    links = near_copies.confirmed_links(a, b, label, sets, 4, 0.8)
    assert links and set(links) <= set(pairs) and lowest_reachable(range(70), same + links) == lowest_reachable(range(70), same + pairs)


def test_shingles():
    for text in ("", "one two", "one two three four five", "One  TWO\tthree four five six"):
        hashes, whole = near_copies.shingle_hashes(text)
        assert len(set(hashes.tolist())) == len(shingles(text) - {()}) and near_copies.shingle_hashes(text.lower())[1] == whole
    again = near_copies.shingle_hashes("a b c d e x a b c d e")[0]
    assert len(again) == 7 and len(set(again.tolist())) == 6
    keys = near_copies.band_keys(np.unique(again))
    assert len(set(keys.tolist())) == near_copies.BANDS == len(keys)


def test_every_near_copy_of_the_table_is_found(spark):
    """All pairs of different texts of the table with a similarity of 0.8 or more, found by an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    close = set()
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                close.add((i, j))
    component = {r.id: r.component for r in near_copies.groups(docs).collect()}
    assert close and all(component[i] == component[j] for i, j in close)
    wanted = lowest_reachable(sets, close)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {i for i, low in wanted.items() if i == low}


def test_sets_of_shingles_are_made_once_per_task(spark):
    """Rows of one text in a task give one set, with all that is needed after it."""
    rows = spark.createDataFrame([(7, n % 2, 3, f"a b c d e f {n % 2}") for n in range(40)], "component long, node long, print long, text string").coalesce(1)
    got = near_copies.shingle_sets(rows)
    assert got.columns == ["component", "node", "print", "shingles"] and sorted(r.node for r in got.collect()) == [0, 1]


def test_rows_repeated_with_id_and_text(spark):
    """A group in which one text is repeated with its id many times, over several files, keeps one row."""
    near = " ".join(f"w{n}" for n in range(60))
    df = spark.createDataFrame([(1, near)] * 300 + [(2, near + " end")] * 300 + [(3, "quite another text with its own words")], "doc_id long, text string").repartition(6)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [1, 3]
