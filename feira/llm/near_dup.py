"""Near duplicates by improved consistent weighted sampling (ICWS).

1. Every text becomes a weighted set of 5-word shingles: weight =
   (1 + ln tf) * idf. Document frequencies are counted over all documents in
   a table of 2^18 hashed buckets (one fixed-size row of a count sketch), so
   the table that is broadcast has a fixed size at any corpus size.
   idf = 1 + IDF_STRENGTH * (1 - ln df / ln N), between 1 and 1 + IDF_STRENGTH:
   damped, because a shingle that a large group of copies shares is frequent
   just because of the copies; a raw idf would let the few edited words of
   each copy outweigh everything they have in common.
2. ICWS draws SAMPLES samples per text; two texts agree on a sample with a
   probability equal to their weighted Jaccard similarity. BANDS bands of
   ROWS samples give bucket keys (recall of a pair at 0.8: 99.8%, at 0.85:
   99.99%).
3. Texts that are equal byte for byte are one node (64-bit hash), so copies
   are never expanded. First every member of a bucket meets the bucket's
   leader, the member that shares most buckets (the original of a group of
   copies, usually); these pairs are checked on whole texts, and verified links
   are contracted to components. Then only pairs of different components that
   share a bucket are left. They are compared by their SAMPLES samples, in
   blocks of about BLOCK members, so a bucket of any size is spread over many
   tasks; a pair is looked at in the first bucket it shares. Pairs that agree on
   at least SKETCH samples (a pair at 0.8 does with 99.6%, at 0.85 with 99.99%)
   are checked on whole texts too, until their components are united. No candidate is dropped, and pairs already
   known to be in one class are the only ones skipped.
4. Verified pairs (similarity >= THRESHOLD) are merged to classes.

Defined cases: a null or blank text is never a duplicate and forms its own
class; a text with fewer than five words has one shingle, all its words;
words are split at ASCII white space, A-Z lower-cased. Repeated rows and
repeated ids fall into the class of their text. The class id is the smallest
id in the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._filter import bit_filter, passes, unpacked
from feira.llm._ship import map_arrow
from feira.llm._graph import components
from feira.llm._store import cut

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 5
SAMPLES = BANDS * ROWS
DF_BITS = 18
IDF_STRENGTH = 0.25
SKETCH = 54
BLOCK = 256


def _weighted(texts: pa.Array, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, text index, weight), each shingle of a text once, by text."""
    codes, counts, vocabulary = T.words(texts)
    word_hash = T.hash_strings(vocabulary.to_pylist())[codes] if len(codes) else np.zeros(0, np.uint64)
    h, text, _ = T.rolling(word_hash, counts, WIDTH)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(WIDTH - 1):
            has = counts[short] > k
            whole[has] = whole[has] * np.uint64(0x9E3779B97F4A7C15) + word_hash[first[short[has]] + k]
        h, text = np.concatenate([h, T.mix(whole)]), np.concatenate([text, short])
    # one sort of (text, shingle) packed into 16 and 48 bits; a shingle is its 48-bit hash from here on
    packed = np.sort((text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    at = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
    weight = 1 + np.log(np.diff(np.append(at, len(packed))))
    packed = packed[at]
    text, h = (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1)
    if idf is not None:
        weight = weight * idf[h >> np.uint64(48 - DF_BITS)]
    return h, text, weight


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Number of texts per hashed shingle bucket; the last entry is the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << DF_BITS) + 1, np.int64)
        for batch in batches:
            for part in T.slices(batch, "t"):
                h, text, _ = _weighted(part.column("t"), None)
                total[:-1] += np.bincount((h >> np.uint64(48 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
                total[-1] += len(np.unique(text))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    sums = (map_arrow(docs.select(F.col(text_col).alias("t")), count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # at most 2^18 + 1 rows
    out = np.zeros((1 << DF_BITS) + 1, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    n = max(int(frequencies[-1]), 2)
    share = np.log(np.maximum(frequencies[:-1], 1)) / np.log(n)
    return 1 + IDF_STRENGTH * (1 - np.clip(share, 0, 1))


class Sampler:
    """ICWS of weighted sets, drawn from tables of the two Gamma(2, 1) variates."""

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        q = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.ones_like(q)
        for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = q, kept positive
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
        self.r = x.astype(np.float32)
        self.ln_c = np.log(x).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 62, samples, dtype=np.uint64)
        self.samples = samples

    def __call__(self, h: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int, block: int = 1 << 16) -> np.ndarray:
        """samples[text, k] for texts 0..n-1 (rows of texts without shingles stay 0)."""
        out = np.zeros((n, self.samples), np.uint64)
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(text))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
            lo, hi = starts[i], ends[j - 1]
            self._block(h[lo:hi], np.log(weight[lo:hi]).astype(np.float32), starts[i:j] - lo, text[starts[i:j]], out)
            i = j
        return out

    def _block(self, h, ln_w, starts, rows, out) -> None:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        for k in range(self.samples):
            x = h * self.mul[k]
            x += self.add[k]
            x ^= x >> np.uint64(29)
            lane = x.view(np.uint16).reshape(-1, 4)
            r = self.r[lane[:, 3]]
            beta = lane[:, 1] * np.float32(1 / 65536)
            t = ln_w / r
            t += beta
            np.floor(t, out=t)
            beta -= 1
            a = t - beta
            a *= r
            np.subtract(self.ln_c[lane[:, 2]], a, out=a)
            low = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == low[owner])
            if len(hit) > len(starts):  # ties: the first of each text
                hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            out[rows, k] = T.mix(h[hit] ^ T.mix(t[hit].astype(np.int64).view(np.uint64) + np.uint64(k + 1)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """[text, band] bucket keys of 32-bit samples."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(samples), b + 1, np.uint64)
        for r in range(ROWS):
            k = T.mix(k * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + r].astype(np.uint64))
        keys[:, b] = k
    return keys


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _signatures(texts: DataFrame, idf) -> DataFrame:
    """(node, samples, keys) of every text with a word, drawn once for the
    copies that one task reads; equal texts have equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, seen = Sampler(), np.zeros(0, np.int64)
        for batch in batches:
            node, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            new = ~np.isin(node, seen, assume_unique=True)
            seen = np.concatenate([seen, node[new]])
            batch = batch.take(pa.array(np.sort(first[new])))
            for part in T.slices(batch, "t"):
                h, text, weight = _weighted(part.column("t"), idf.value)
                has = np.unique(text)
                if not len(has):
                    continue
                drawn = (sampler(h, text, weight, part.num_rows)[has] >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(has)), _lists(drawn.view(np.int32)),
                     _lists(T.signed(band_keys(drawn)))], ["node", "samples", "keys"])

    return map_arrow(texts, run, "node long, samples array<int>, keys array<long>")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, t), once for each of ``nodes``. A bit filter spares the shuffle of all other texts."""
    packed = texts.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(F.col("node").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(packed.value)
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("node").to_numpy().view(np.uint64))))

    some = map_arrow(texts.select("node", "t"), run, "node long, t string")
    return some.join(nodes, "node").groupBy("node").agg(F.first("t").alias("t"))


def _is_similar(a: tuple, b: tuple) -> bool:
    """Whether two (shingles in order, weights, sum of weights) reach THRESHOLD."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = np.minimum(b[1][at[same]], a[1][same]).sum()
    return bool(shared >= (THRESHOLD - 1e-9) * (a[2] + b[2] - shared))


def _similar(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches THRESHOLD; ``texts``: (node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "tb"):
                keep = []
                a_col = part.column("a").to_numpy()
                h, text, weight = _weighted(part.column("tb"), idf.value)
                cut_b = np.searchsorted(text, np.arange(part.num_rows + 1))
                known: tuple | None = None
                for i in range(part.num_rows):
                    if known is None or known[0] != a_col[i]:
                        ha, _, wa = _weighted(part.column("ta").slice(i, 1), idf.value)
                        known = (a_col[i], (ha, wa, wa.sum()))
                    own = slice(cut_b[i], cut_b[i + 1])
                    keep.append(_is_similar(known[1], (h[own], weight[own], weight[own].sum())))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)),
                                                  part.column("b").filter(pa.array(keep))], ["a", "b"])

    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
              .select("a", "b", "ta", "tb"))
    return map_arrow(joined, run, "a long, b long")


def _uniting(a: list[int], b: list[int], comp: list[int], of: dict[int, tuple]) -> list[int]:
    """Places of the similar pairs that unite two components, in the order of the pairs."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for k, (x, y) in enumerate(zip(a, b)):
        one, two = find(comp[x]), find(comp[y])
        if one != two and _is_similar(of[x], of[y]):
            root[max(one, two)] = min(one, two)
            out.append(k)
    return out


def _similar_in_blocks(members: DataFrame, idf) -> DataFrame:
    """Components (a, b) that a similar pair in a bucket links, enough pairs to unite them.

    ``members``: (bucket, node, comp, samples, n, t), n the bucket's size. Pairs
    that agree on SKETCH samples are checked on their texts, in the same task,
    those that agree most first; a pair whose components are already united in
    its block adds nothing and is passed over. So a block yields fewer links
    than it has components, however many of its pairs are similar.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    dealt = (members.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
             .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") <= F.col("other")).alias("first"), "comp", "samples", "t"))

    def compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        comp = rows["comp"].to_numpy()
        samples = rows["samples"].combine_chunks().values.to_numpy().reshape(len(comp), SAMPLES)
        if rows["i"][0].as_py() == rows["j"][0].as_py():
            a, b = np.triu_indices(len(comp), 1)
        else:
            first = rows["first"].to_numpy()
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        differ = comp[a] != comp[b]
        a, b = a[differ], b[differ]
        agree = np.concatenate([(samples[a[k:k + 20_000]] == samples[b[k:k + 20_000]]).sum(1)
                                for k in range(0, len(a), 20_000)]) if len(a) else np.zeros(0, np.int64)
        best = np.argsort(-agree, kind="stable")
        best = best[agree[best] >= SKETCH]
        a, b = a[best], b[best]
        if len(a):  # only in the first bucket that the pair shares
            keys = band_keys(samples.view(np.uint32))
            shared = keys[a] == keys[b]
            here = T.signed(keys[a, shared.argmax(1)].copy()) == rows["bucket"][0].as_py()
            a, b = a[here], b[here]
        if len(a):
            used = np.unique(np.concatenate([a, b]))
            h, text, weight = _weighted(rows["t"].combine_chunks().take(pa.array(used)), idf.value)
            cuts = np.searchsorted(text, np.arange(len(used) + 1))
            of = {u: (h[s:e], weight[s:e], weight[s:e].sum()) for u, s, e in zip(used.tolist(), cuts[:-1], cuts[1:])}
            good = _uniting(a.tolist(), b.tolist(), comp.tolist(), of)
            a, b = a[good], b[good]
        return comp[a], comp[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            a, b = compare(pa.Table.from_batches(waiting))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if last is not None and tuple(key[start]) != last:
                    yield out()
                    waiting = []
                last = tuple(key[start])
                waiting.append(batch.slice(start, end - start))
        if waiting:
            yield out()

    place = ["bucket", "i", "j"]
    return map_arrow(dealt.repartition(*place).sortWithinPartitions(*place), run, "a long, b long")


def classes_of_nodes(texts: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have a link; ``texts``: (node, t)."""
    idf = texts.sparkSession.sparkContext.broadcast(idf_table(document_frequencies(texts, "t")))
    drawn = cut(_signatures(texts, idf).dropDuplicates(["node"]))
    band = drawn.select("node", F.explode("keys").alias("bucket"))
    crowded = band.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(band.join(crowded, "bucket"))
    popular = members.groupBy("node").agg(F.sum("n").alias("met"))
    lead = cut(members.join(popular, "node").groupBy("bucket")
               .agg(F.max(F.struct("met", "node"))["node"].alias("lead")))
    star = (members.join(lead, "bucket").filter("node <> lead")
            .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    own_text = cut(_texts_of(texts, members.select("node").distinct()))
    links = cut(_similar(cut(star), own_text, idf))
    comps = cut(components(links))
    seen = (members.join(comps, "node", "left")
            .select("bucket", "node", "n", F.coalesce("component", "node").alias("comp")))
    live = seen.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    left = seen.join(live, "bucket").join(drawn.select("node", "samples"), "node").join(own_text, "node")
    # of the components that are left, few have a link; a text without a star link is a component of its own
    united = cut(components(_similar_in_blocks(left, idf)))
    upper = united.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return (comps.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            .union(united).distinct())


def _node(text_col: str) -> Column:
    """The hash of a text; null if it is null or blank."""
    text = F.col(f"`{text_col}`")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))  # stops at the first word


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id as doc_id, class_id (smallest id of its class), is_kept.

    is_kept marks the row whose id is the class id (repeated rows of that id
    are all marked; ``deduplicate`` keeps one of them).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _node(text_col).alias("node"), F.col(f"`{text_col}`").alias("t"))
    texts = rows.filter("node IS NOT NULL").select("node", "t")
    comp = cut(classes_of_nodes(texts))
    keyed = (rows.drop("t").join(comp, "node", "left")
             .select("doc_id", F.coalesce("component", "node").alias("comp")))
    least = keyed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return (keyed.join(least, "comp", "left")
            .select("doc_id", F.coalesce("least", "doc_id").alias("class_id"))
            .withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, one per class: the row with the class's smallest id (of
    repeated rows with that id, one; rows without an id only if the class has
    no other). Rows without a text are no duplicates; of those with the same
    id and text, one stays. Columns as they came."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text_col}`").alias("t"), _node(text_col).alias("node"))
    comp = cut(classes_of_nodes(rows.filter("node IS NOT NULL").select("node", "t")))
    # the decision is on (id, text): an id may be given to texts of several classes
    counted = (rows.filter("node IS NOT NULL").groupBy("node", "id").agg(F.count("*").alias("n")).join(comp, "node", "left"))
    best = (counted.groupBy(F.coalesce("component", "node").alias("comp"))
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "n")).alias("best")))
    keep = cut(best.select(F.col("best.id").alias("kept_id"), F.col("best.node").alias("kept_node"), F.col("best.n").alias("n")))
    body = rows.join(keep, F.col("node").eqNullSafe(F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id")))
    single = body.filter("n = 1").select("row")
    several = body.filter("n > 1").dropDuplicates(["id", "node"]).select("row")
    blank = rows.filter("node IS NULL")
    named = blank.filter("id IS NOT NULL").dropDuplicates(["id", "t"]).select("row")
    without = blank.filter("id IS NULL").select("row")
    return single.unionByName(several).unionByName(named).unionByName(without).select("row.*")
