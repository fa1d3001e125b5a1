"""Similarity join of word n-gram sets, counted fragment by fragment.

Links every two documents whose sets of WIDTH-word shingles have a Jaccard
similarity of PERCENT / 100 or more, exactly, and returns the components.

1. Global order: a shingle's place is (estimated frequency, hash), rarest
   first. The estimate is the least of four upper bounds that come from two
   count sketches of fixed size: of the shingle and of its three words. Any
   order gives the same links; a better one gives fewer candidates.
2. Documents with equal sets (128-bit hash) are one node, so copies are
   never paired. A node is its size, its prefix (the rarest tenth: two similar
   sets share a token in their prefixes) and a parity bitmap of its tokens,
   about two bits a token: the Hamming distance of two bitmaps never exceeds
   the number of tokens that only one of the sets has.
3. Candidates: nodes that share a prefix token; of these only the ones whose
   sizes and positions allow a partner. First every member of a token's bucket meets the bucket's leader only; links found are contracted
   to components. Then the pairs of different components that share a token are
   compared inside the tasks, in blocks of BLOCK members, by position and
   bitmap; what may still be similar comes out. Both tests only drop pairs
   that cannot reach the threshold.
4. Exact counts by vertical partitioning: the global order is cut at pivots
   into FRAGMENTS of about equal weight. A candidate's set goes out as one
   segment per fragment; the overlaps of each fragment are counted on
   their own, in other tasks, and summed per pair. A leader with many partners
   is dealt out in groups of PARTNERS, a very long text in FRAGMENTS pieces.

Defined cases: words are split at ASCII white space, A-Z lower-cased; a text
with fewer words than WIDTH has one shingle, the whole sequence; a null or
blank text has an empty set and no links. Repeated ids and rows each get a row;
a null id is never a component's smallest id unless it has no other. Tokens
are 56-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from feira.llm import _text as T
from feira.llm._filter import bit_filter, passes, unpacked
from feira.llm._graph import components
from feira.llm._ship import map_arrow
from feira.llm._store import cut

WIDTH = 3
PERCENT = 90
FRAGMENTS = 4
SKETCH_BITS = 17
BLOCK = 256
PARTNERS = 256
LEVELS = 256  # steps of the estimated frequency in a token's top byte


def needed(sizes: Column | np.ndarray):
    """Least overlap, times 100 + PERCENT, of two similar sets with ``sizes`` tokens together."""
    return sizes * PERCENT


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of the prefix of a set of n: a similar set that is not longer has one of them."""
    return n - (PERCENT * n + 99) // 100 + 1


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, text index, first word's place, word hashes) of all shingles, repeats included, not sorted."""
    codes, counts, vocabulary = T.words(texts)
    word = T.hash_strings(vocabulary.to_pylist())[codes] if len(codes) else np.zeros(0, np.uint64)
    h, text, at = T.rolling(word, counts, WIDTH)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    place = first[text] + at
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        whole = counts[short].astype(np.uint64)  # the number of words tells these from whole shingles
        for k in range(WIDTH - 1):
            has = counts[short] > k
            whole[has] = T.mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + word[first[short[has]] + k])
        h, text, place = (np.concatenate([h, T.mix(whole)]), np.concatenate([text, short]),
                          np.concatenate([place, -1 - first[short]]))
    return h, text, place, word


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketches(texts: DataFrame) -> np.ndarray:
    """Occurrences per hashed bucket of shingles (first half) and of words (second half)."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for part in T.slices(batch, "t"):
                h, _, _, word = _hashed(part.column("t"))
                total[:size] += np.bincount(_bucket(h), minlength=size)
                total[size:] += np.bincount(_bucket(word), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = (map_arrow(texts.select("t"), count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # at most 2^18 rows
    out = np.zeros(2 * size, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of a sixth of a doubling."""
    return np.minimum(6 * np.log2(np.maximum(counts, 1)), LEVELS - 1).astype(np.uint8)


def token_sets(texts: pa.Array, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, text index): each token of a text once, in the global order."""
    size = 1 << SKETCH_BITS
    h, text, place, word = _hashed(texts)
    level = levels[:size][_bucket(h)]
    if len(word):
        of_word = levels[size:][_bucket(word)]
        rarest = of_word.copy()
        for k in range(1, WIDTH):  # of WIDTH words from each place on; only read where a shingle begins
            rarest[:len(word) - k] = np.minimum(rarest[:len(word) - k], of_word[k:])
        level = np.minimum(level, np.where(place >= 0, rarest[np.maximum(place, 0)], of_word[np.maximum(-1 - place, 0)]))
    token = (level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    order = np.argsort(token)
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    token, text = token[order], text[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (text[1:] != text[:-1])] if len(token) else np.zeros(0, bool)
    return token[new], text[new]


def _bits(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, twice the size at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit, as bytes."""
    width = _bits(len(tokens))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits from a wider one (64-bit words)."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width // 64), axis=0)


def _signatures(rows: DataFrame, levels) -> DataFrame:
    """(doc_id, text_key, key, n, prefix, bits) of every row, ``key`` the set's
    hash; and one row a task whose ``prefix`` counts its tokens by level (key and doc_id null, n -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(LEVELS, np.int64)
        names = ["doc_id", "text_key", "key", "n", "prefix", "bits"]
        for batch in batches:
            for part in T.slices(batch, "t"):
                token, text = token_sets(part.column("t"), levels.value)
                weight += np.bincount((token >> np.uint64(56)).astype(np.int64), minlength=LEVELS)
                n = np.bincount(text, minlength=part.num_rows).astype(np.int64)
                start = np.concatenate([[0], np.cumsum(n)])
                has = np.flatnonzero(n)
                keys, bits = [None] * part.num_rows, [None] * part.num_rows
                if len(has):
                    one = np.add.reduceat(T.mix(token ^ np.uint64(0xA5A5A5A5)), start[has])
                    two = np.add.reduceat(T.mix(token + np.uint64(0x632BE59BD9B4E019)), start[has])
                    for i, (x, y) in zip(has.tolist(), np.column_stack([one, two]).tolist()):
                        keys[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
                        bits[i] = bitmap(token[start[i]:start[i + 1]]).tobytes()
                p = np.where(n > 0, prefix_length(n), 0)
                at = np.repeat(start[:-1], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32()),
                                                  pa.array(T.signed(token[at].copy())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(n),
                     prefix, pa.array(bits, pa.binary())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, id_arrow), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([-1], pa.int64()),
             pa.array([weight.tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.binary())], names)

    id_arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, key binary, "
                                "n long, prefix array<long>, bits binary")


def pivots(weight: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Tokens at which the global order is cut into fragments of about equal
    weight; inside a level tokens are hashes, spread evenly."""
    upto = np.concatenate([[0], np.cumsum(weight)]).astype(np.float64)
    out = []
    for k in range(1, fragments):
        want = upto[-1] * k / fragments
        level = min(int(np.searchsorted(upto, want, side="right")) - 1, LEVELS - 1)
        share = (want - upto[level]) / max(weight[level], 1)
        out.append((level << 56) + min(int(share * (1 << 56)), (1 << 56) - 1))
    return np.array(out, np.uint64)


def _segments(texts: DataFrame, wanted: DataFrame, levels, cuts: np.ndarray) -> DataFrame:
    """(node, fragment, tokens) of the nodes in ``wanted`` (node, text_key); tokens ascending, 8 bytes each."""
    packed = texts.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("text_key").alias("hash"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(packed.value)
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("text_key").to_numpy().view(np.uint64))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                token, text = token_sets(part.column("t"), levels.value)
                piece = text * FRAGMENTS + np.searchsorted(cuts, token, side="right")
                at = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
                raw, ends = token.astype("<u8").tobytes(), np.append(at[1:], len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(text[at])), pa.array(piece[at] % FRAGMENTS, pa.int32()),
                     pa.array([raw[8 * s:8 * e] for s, e in zip(at.tolist(), ends.tolist())], pa.binary())],
                    ["node", "fragment", "tokens"])

    some = map_arrow(texts.select("text_key", "t"), pick, "text_key long, t string")
    own = some.join(wanted, "text_key").dropDuplicates(["node"]).select("node", "t")
    return map_arrow(own, split, "node long, fragment int, tokens binary")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(lead, member, overlap) of the pairs (lead, member) that share a token:
    counted per fragment, summed per pair."""
    groups = F.ceil(F.col("partners") / PARTNERS)
    dealt = (pairs.join(pairs.groupBy("lead").agg(F.count("*").alias("partners")), "lead")
             .select("lead", "member", F.pmod(F.xxhash64("member"), groups).alias("part")))
    leads = (dealt.select("lead", "part").distinct()
             .join(segments.withColumnRenamed("node", "lead"), "lead")
             .select("lead", "part", "fragment", F.lit(None).cast("long").alias("member"), "tokens"))
    members = (dealt.join(segments.withColumnRenamed("node", "member"), "member")
               .select("lead", "part", "fragment", "member", "tokens"))
    place = ["lead", "part", "fragment"]
    rows = (leads.unionByName(members).repartition(*place)
            .sortWithinPartitions(*place, F.col("member").asc_nulls_first()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for lead, part, fragment, member, raw in zip(*(batch.column(c).to_pylist()
                                                           for c in (*place, "member", "tokens"))):
                tokens = np.frombuffer(raw, "<u8")
                if member is None:
                    here, own = (lead, part, fragment), tokens
                elif here == (lead, part, fragment):  # else the leader has no token in this fragment
                    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    out.append((lead, member, int((own[at] == tokens).sum())))
            if out:
                a, b, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                                                 ["lead", "member", "overlap"])

    return (map_arrow(rows, run, "lead long, member long, overlap long")
            .groupBy("lead", "member").agg(F.sum("overlap").alias("overlap")))


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, levels, cuts: np.ndarray) -> DataFrame:
    """(a, b) of the pairs (lead, member) that are similar."""
    ends = pairs.select(F.explode(F.array("lead", "member")).alias("node")).distinct()
    wanted = cut(nodes.join(ends, "node").select("node", "text_key"))
    counted = overlaps(pairs, cut(_segments(texts, wanted, levels, cuts)))
    size = nodes.select("node", "n")
    return (counted.join(size.select(F.col("node").alias("lead"), F.col("n").alias("n_lead")), "lead")
            .join(size.select(F.col("node").alias("member"), F.col("n").alias("n_member")), "member")
            .filter(F.col("overlap") * 100 >= (F.col("n_lead") + F.col("n_member") - F.col("overlap")) * PERCENT)
            .select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b")))


def _may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs of rows a, b their bitmaps do not rule out."""
    width = np.array([64 * len(x) for x in bits])
    both = np.minimum(width[a], width[b])
    total = n[a] + n[b]
    differ = total - 2 * -(-needed(total) // (100 + PERCENT))  # tokens that similar sets may not share
    out = np.zeros(len(a), bool)
    for w in np.unique(both).tolist():
        own = np.flatnonzero(both == w)
        used, at = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
        table = np.stack([folded(bits[i], w) for i in used.tolist()])
        step = max(1, (1 << 18) // (w // 64))
        for s in range(0, len(own), step):
            some = own[s:s + step]
            left, right = table[at[s:s + len(some)]], table[at[len(own) + s:len(own) + s + len(some)]]
            out[some] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64) <= differ[some]
    return out


def _words64(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in raw]


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (lead, member) that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = _words64(batch.column("bits_lead").to_pylist()) + _words64(batch.column("bits_member").to_pylist())
            n = np.concatenate([batch.column("n_lead").to_numpy(), batch.column("n_member").to_numpy()])
            at = np.arange(batch.num_rows)
            good = _may_be_similar(at, at + batch.num_rows, n, bits)
            yield batch.select(["lead", "member"]).filter(pa.array(good))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    joined = (pairs.join(side("member"), "member").join(side("lead"), "lead")
              .select("lead", "member", "n_lead", "n_member", "bits_lead", "bits_member"))
    return map_arrow(joined, run, "lead long, member long")


def _in_play(members: DataFrame) -> DataFrame:
    """The members (token, crowd, node, n, pos) whose positions allow a partner
    in their bucket, ``crowd`` counted anew. Buckets of more than BLOCK members come out whole, dealt over many tasks."""

    def partnered(rows: pa.Table) -> pa.RecordBatch:
        token, crowd, n = (rows[c].to_numpy() for c in ("token", "crowd", "n"))
        left = n - rows["pos"].to_numpy()
        found = crowd > BLOCK
        i = np.flatnonzero(~found)
        for step in range(1, len(token)):  # every row with the one ``step`` rows on, while that is in its bucket
            i = i[i + step < len(token)]
            i = i[token[i] == token[i + step]]
            if not len(i):
                break
            j = i + step
            good = np.minimum(left[i], left[j]) * (100 + PERCENT) >= needed(n[i] + n[j])
            found[i[good]] = True
            found[j[good]] = True
        kept = rows.filter(pa.array(found)).combine_chunks()
        token, crowd = token[found], crowd[found]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(token)))
        crowd = np.where(crowd > BLOCK, crowd, np.repeat(size, size))
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(crowd), *(kept[c].combine_chunks() for c in ("node", "n", "pos"))],
                                          ["token", "crowd", "node", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            token = waiting["token"].to_numpy()
            if not len(token):
                continue
            whole = int(np.searchsorted(token, token[-1])) if waiting["crowd"][-1].as_py() <= BLOCK else len(token)
            if whole:
                yield partnered(waiting.slice(0, whole))
                waiting = waiting.slice(whole)
        if waiting is not None and len(waiting):
            yield partnered(waiting)

    salt = F.when(F.col("crowd") > BLOCK, F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / BLOCK))).otherwise(0)
    dealt = (members.select("token", F.col("crowd"), "node", "n", F.col("pos").cast("long").alias("pos"), salt.alias("salt"))
             .repartition("token", "salt").sortWithinPartitions("token").drop("salt"))
    return map_arrow(dealt, run, "token long, crowd long, node long, n long, pos long")


def _pairs_in_blocks(members: DataFrame) -> DataFrame:
    """The pairs (lead, member) of different components in a bucket that
    position and bitmap allow; members: (token, crowd, node, comp, n, pos, bits)."""
    blocks = F.ceil(F.col("crowd") / BLOCK)
    dealt = (members.withColumn("own", F.pmod(F.xxhash64("node"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
             .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") <= F.col("other")).alias("first"), "node", "comp", "n", "pos", "bits"))
    place = ["token", "i", "j"]

    def compare(rows: pa.Table) -> pa.RecordBatch:
        n, comp, node = rows["n"].to_numpy(), rows["comp"].to_numpy(), rows["node"].to_numpy()
        left = n - rows["pos"].to_numpy()  # tokens from the shared one on
        if rows["i"][0].as_py() == rows["j"][0].as_py():
            a, b = np.triu_indices(len(n), 1)
        else:
            first = rows["first"].to_numpy()
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        good = (comp[a] != comp[b]) & (np.minimum(left[a], left[b]) * (100 + PERCENT) >= needed(n[a] + n[b]))
        a, b = a[good], b[good]
        if len(a):
            good = _may_be_similar(a, b, n, _words64(rows["bits"].to_pylist()))
            a, b = a[good], b[good]
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["lead", "member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy() for c in place])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if last is not None and tuple(key[start]) != last:
                    yield compare(pa.Table.from_batches(waiting))
                    waiting = []
                last = tuple(key[start])
                waiting.append(batch.slice(start, end - start))
        if waiting:
            yield compare(pa.Table.from_batches(waiting))

    out = map_arrow(dealt.repartition(*place).sortWithinPartitions(*place), run, "lead long, member long")
    return out.select(F.least("lead", "member").alias("lead"), F.greatest("lead", "member").alias("member")).distinct()


def _node_components(drawn: DataFrame, texts: DataFrame, levels, cuts: np.ndarray) -> DataFrame:
    """(node, component) of the nodes that have a link; drawn: (node, text_key, n, prefix, bits)."""
    band = drawn.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    crowded = cut(band.groupBy("token").agg(F.count("*").alias("crowd")).filter("crowd > 1"))
    packed = drawn.sparkSession.sparkContext.broadcast(bit_filter(crowded.select(F.col("token").alias("hash"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(packed.value)
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("token").to_numpy().view(np.uint64))))

    some = map_arrow(band, pick, "node long, n long, pos int, token long")
    members = cut(_in_play(some.join(crowded, "token")))
    popular = members.groupBy("node").agg(F.sum("crowd").alias("met"))
    lead = (members.join(popular, "node").groupBy("token")
            .agg(F.max(F.struct("met", "node", "n", "pos")).alias("lead")))
    rest = F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos"))
    star = (members.join(lead, "token").filter(F.col("node") != F.col("lead.node"))
            .filter(rest * (100 + PERCENT) >= needed(F.col("n") + F.col("lead.n")))
            .select(F.col("lead.node").alias("lead"), F.col("node").alias("member")).distinct())
    links = cut(_links(cut(_plausible(star, drawn)), drawn, texts, levels, cuts))
    comps = components(links)
    seen = members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    live = seen.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    left = seen.join(live, "token").join(drawn.select("node", "bits"), "node")
    more = cut(_links(cut(_pairs_in_blocks(left)), drawn, texts, levels, cuts))
    return components(links.unionByName(more))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id)."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
                       text.alias("t"))
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(levels_of(sketches(rows)))
    signed = cut(_signatures(rows, levels))
    weight = (signed.filter("n = -1").select(F.posexplode("prefix").alias("level", "w")).groupBy("level")
              .agg(F.sum("w").alias("w")).collect())  # LEVELS rows
    order = np.zeros(LEVELS, np.int64)
    for r in weight:
        order[r["level"]] = r["w"]
    drawn = cut(signed.filter("key IS NOT NULL").dropDuplicates(["key"])
                .select(F.monotonically_increasing_id().alias("node"), "key", "text_key", "n", "prefix", "bits"))
    comp = cut(_node_components(drawn, rows.select("text_key", "t"), levels, pivots(order)))
    comp = drawn.select("key", "node").join(comp, "node", "left").select("key", F.coalesce("component", "node").alias("comp"))
    keyed = (signed.filter("n >= 0").select("doc_id", F.col("n").alias("n_shingles"), "key").join(comp, "key", "left")
             .drop("key"))
    least = keyed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return (keyed.join(least, "comp", "left")
            .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")))
