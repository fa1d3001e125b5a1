"""Zone-map clustering, the Merkle manifest and the fragment join against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feira.llm import fragment_join, merkle, zone_clusters
from feira.llm._order import positions

# --- zone clusters ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, size int, zone string, vec string, curve int, row int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "z", "v", 2, 3) for i, v in rows], VECTORS)


def vector_set(n=400, seed=3, spread=0.05):
    r = np.random.default_rng(seed)
    middles = r.normal(0, 1, (12, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 12] + r.normal(0, spread, 64)]) for i in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(60)]  # one common vector
    rows += [(5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(9001, None), (9002, [1.0] * 63), (9003, [1.0] * 65), (9004, [None] + [0.0] * 63), (9005, [float("nan")] * 64),
             (9006, [float("inf")] + [0.0] * 63), (9007, [])]
    return rows


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(q, "<i4").tobytes(), q)
                   for i, q in kept if i is not None)[:k]
    centroids = [list(q) for _, _, q in seeds]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[nearest(q)[1]].append(q)
        for j, members in own.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    best = [(i, *nearest(q)) for i, q in kept]
    spent = defaultdict(int)
    for _, d, j in best:
        spent[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, spent[j], sum(spent.values()), digest[j]) for i, d, j in best), key=str)


def clustered(spark, rows):
    return sorted((tuple(r) for r in zone_clusters.clusters(vector_frame(spark, rows)).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rows = vector_set()
    assert clustered(spark, rows) == brute_clusters(rows)


def test_fewer_vectors_than_centroids_large_components_and_no_vectors(spark):
    few = [(i, [float(i * 100_000.5 - j) for j in range(64)]) for i in range(5)]
    assert clustered(spark, few) == brute_clusters(few)
    assert clustered(spark, []) == [] and clustered(spark, [(1, [0.0])]) == []
    with pytest.raises(Exception, match="would not fit a long"):
        clustered(spark, [(1, [1e30] * 64)])


def test_zone_maps_leave_out_far_centroids_only():
    r = np.random.default_rng(1)
    block = r.integers(-20, 20, (50, 64))
    zone = zone_clusters.Zone(block.min(0), block.max(0), block.sum(0))
    centroids = np.concatenate([r.integers(-20, 20, (4, 64)), r.integers(400, 500, (6, 64))])
    some = zone_clusters.candidates(zone, centroids)
    assert set(some) <= set(range(4))
    full = ((block[:, None] - centroids) ** 2).sum(2)
    cluster, d = zone_clusters.nearest(block, zone, centroids)
    assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()


def test_hilbert_order_visits_neighbouring_cells():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = zone_clusters.hilbert_keys(grid, bits=3)
    path = grid[np.lexsort(keys.T[::-1])]
    assert len({bytes(k) for k in keys}) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- Merkle manifest -------------------------------------------------------------------------

ROWS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, presented int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves):
    """(root, witness of each leaf as [(before, after), ...])."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, j in enumerate(at):
            run = level[j // 16 * 16:j // 16 * 16 + 16]
            paths[k].append(("".join(run[:j % 16]), "".join(run[j % 16 + 1:])))
            at[k] = j // 16
        level = [digest("".join(level[s:s + 16])) for s in range(0, len(level), 16)]
    return (level[0] if level else None), paths


def brute_manifest(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(*row[:5]), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in sources[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, own, row), path in zip(sources[s], trees[s][1]):
            path = path + above[k]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(row[0], text, *row[2:5])
            for before, after in path:
                folded = digest(before + folded + after)
            out.append((row[0], own, trees[s][0], root, digest("".join(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, "d", 0) for r in rows], ROWS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return sorted((tuple(r) for r in merkle.check(merkle.document_leaves(docs, tampered)).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [256, 257, 300, 15], [2] * 18, [4100, 3]])
def test_manifest_equals_brute_force(spark, sizes):
    rows, r = [], random.Random(len(sizes))
    for s, n in enumerate(sizes):
        name = None if s == 0 else "" if s == 1 else f"q{s}é"
        for _ in range(n):
            i = r.randrange(10 ** 9)
            rows.append((i, r.choice([None, "", f"Text {i} ß", "abc", f"X{i}\n"]), r.choice([None, "en"]), name, r.choice([None, i])))
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "a", None, "s", 1)] * 20 + [(7, "Long " * 20_000, "en", "s", 2)] * 3 + [(7, "B", "en", "s", None), (8, None, None, None, None)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, []) == []


def test_witnesses_grow_with_later_siblings():
    block = merkle.Subtree(first=True)
    first = merkle.Node(digest("0"))
    block.append(first)
    lengths = [len(first.witness())]
    for i in range(1, merkle.SPAN):
        block.append(merkle.Node(digest(str(i))))
        lengths.append(len(first.witness()))
    assert lengths[14:16] == [0, 2] and lengths[-2:] == [2, 4]
    assert merkle.fold(first.digest, first.witness()) == block.root().digest


def test_positions_split_hot_groups_and_equal_rows(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 3).alias("v")).unionByName(
        spark.createDataFrame([("h", 1), ("a", 2)], "g string, v long")).repartition(7)
    out = positions(rows, "g", [F.col("v").asc()]).collect()
    assert sorted(r.pos for r in out if r.g == "g") == list(range(5000))
    assert [r.v for r in sorted((r for r in out if r.g == "g"), key=lambda r: r.pos)] == sorted(r.v for r in out if r.g == "g")
    assert {(r.g, r.pos) for r in out if r.g != "g"} == {("h", 0), ("a", 0)}


# --- fragment join ---------------------------------------------------------------------------

DOCS = "doc_id long, text string, n long, node string, t string, token long, lead string"


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_links(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def joined(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "n", "t", 2, "l") for r in rows], DOCS)
    return sorted((tuple(r) for r in fragment_join.linked(docs).collect()), key=str)


def near_copies(seed, groups=8, members=12):
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 40, 90, 400]))]
        for k in range(members):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5]) * len(base) // 90 + r.randrange(2)):
                words[r.randrange(len(words))] = f"x{r.randrange(10 ** 6)}"
            rows.append((g * 100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, small):
    if small:  # every split and every block is used
        monkeypatch.setattr(fragment_join, "BLOCK", 3)
        monkeypatch.setattr(fragment_join, "PARTNERS", 2)
    rows = near_copies(4 + small)
    rows += [(3000 + k, t) for k, t in enumerate([None, "", " \t\n", "One", "one", "one two", "two one", "ONE two", "a b c", "A b  c", "a b c a b c"])]
    rows += [(1, rows[1][1]), (None, rows[1][1]), (None, "only without an id here"), (None, None), rows[2], rows[2]]
    assert joined(spark, rows) == brute_links(rows)


def test_shared_passages_and_very_long_texts(spark):
    r = random.Random(9)
    passage = [f"p{k}" for k in range(200)]
    rows = [(i, " ".join(passage + [f"u{r.randrange(10 ** 6)}" for _ in range(12 + i % 14)])) for i in range(60)]
    long = [f"v{r.randrange(5000)}" for _ in range(30_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:28_600])), (902, " ".join(long[:20_000]))]
    assert joined(spark, rows) == brute_links(rows)
    assert joined(spark, []) == []


def test_bitmaps_never_rule_out_a_similar_pair():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 400))
        base = r.integers(0, 1 << 63, n + 60, dtype=np.uint64)
        a, b = np.unique(base[:n]), np.unique(np.r_[base[int(r.integers(0, n // 10 + 1)):n], base[n:n + int(r.integers(0, 1 + n // 12))]])
        same = len(np.intersect1d(a, b))
        bits = [np.frombuffer(fragment_join.bitmap(x).tobytes(), "<u8") for x in (a, b)]
        kept = fragment_join._may_be_similar(np.array([0]), np.array([1]), np.array([len(a), len(b)]), bits)[0]
        assert kept or 100 * same < 90 * (len(a) + len(b) - same)
