"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has its own context tree
over the DEPTH bytes before it. A node at depth d (the last d bytes and the
bits of the symbol so far) holds the counts of zeros and ones seen in training
and the Krichevsky-Trofimov estimate of both; Pw = Pe at depth DEPTH, else
(Pe + product of the children's Pw) / 2. The probability of the next bit is
the exact CTW conditional: at each node of the path, the node's KT estimate
and the deeper mixture, weighted by their posterior shares.

The model is trained once and then scores every text, so the probability of a
byte depends on (context, byte) alone. Spark counts all (DEPTH + 1)-grams of
all texts (with zero counts for those outside the training texts), and the
trees are evaluated bottom-up for whole groups of grams with the same three
last bytes before the symbol (a group holds at most 256^3 grams, whatever the
corpus). A group yields its nodes at that depth; summed over their third byte
they give the level above, which goes back to the groups as a few rows each
(at most 255 nodes), and only the two top levels (at most 256 * 255 nodes)
pass through the driver. The result is a table gram -> log10 probability that covers every gram
of every text: no fallback is needed.

Scoring looks both kinds of features (byte grams, and words for the base
score) up in their tables: the most frequent entries (a fixed number, HEAD
entries each) are broadcast, all others are joined by key after counting them
per text. So frequent keys never meet in one task, and rare ones need no room
in memory.

Text is lower-cased (A-Z) and ends with one zero byte, which is scored too;
before its start the context is zeros. Words are runs of anything but ASCII
white space, plus one end token per text; they are counted by 64-bit hashes.

Defined cases: a null text is empty (one end token, one end byte); rows with
a null id train; repeated rows count as often as they occur; an empty table
gives no rows, and without training texts every bit has probability 1/2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._ship import map_arrow
from feira.llm._store import cut, scratch

DEPTH = 5
#: Depth by which the trees are dealt out. The level above is a table, the top two are on the driver.
DEALT = 3
HEAD = 1 << 20
HEAD_WORDS = 1 << 18
GRAM, WORD = 0, 1
_BUFFER = 1_500_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte and of the end, number of grams of each text)."""
    low = pc.ascii_lower(T.plain(texts))
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[:n + 1] if n else np.zeros(1, np.int64)
    size = np.diff(offsets)
    body = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    padded = np.zeros(len(body) + n * (DEPTH + 1), np.uint8)
    padded[np.arange(len(body)) + np.repeat(np.arange(n), size) * (DEPTH + 1) + DEPTH] = body
    code = np.zeros(max(len(padded) - DEPTH, 0), np.uint64)
    for k in range(DEPTH + 1):
        code <<= np.uint64(8)
        code |= padded[k:len(code) + k]
    return _own(code, size), size + 1


def _own(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The grams that end in a text's bytes or its end, not in padding."""
    n = size + 1
    first = np.concatenate([[0], np.cumsum(size + DEPTH + 1)])[:-1]
    return code[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _add_up(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[at], *[np.add.reduceat(c[order], at) if len(at) else c for c in counts])


def _unique_counts(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct key, occurrences in training texts, all occurrences)."""
    u1, n1 = np.unique(key[train], return_counts=True)
    u0, n0 = np.unique(key[~train], return_counts=True)
    return _add_up(np.concatenate([u1, u0]), np.concatenate([n1, np.zeros(len(n0), np.int64)]), np.concatenate([n1, n0]))


def counted(rows: DataFrame) -> DataFrame:
    """(kind, key, n, seen) of all byte grams and words; ``rows``: (t, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}

        def merged(kind: int) -> tuple[np.ndarray, ...]:
            return _add_up(*[np.concatenate([x[i] for x in held[kind]]) for i in range(3)])

        def out(kind: int, x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), kind, np.int32)), pa.array(T.signed(x[0])),
                                               pa.array(x[1]), pa.array(x[2])], ["kind", "key", "n", "seen"])

        for batch in batches:
            for part in T.slices(batch, "t"):
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                code, n = grams(part.column("t"))
                held[GRAM].append(_unique_counts(code, np.repeat(train, n)))
                words, n, names = T.words(part.column("t"))
                hashed = T.hash_strings(names.to_pylist())
                held[WORD].append(_unique_counts(hashed[words] if len(words) else np.zeros(0, np.uint64), np.repeat(train, n)))
                for kind in held:
                    if sum(len(x[0]) for x in held[kind]) > _BUFFER:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > _BUFFER // 2:
                            yield out(kind, held[kind].pop())
        for kind in held:
            if held[kind]:
                yield out(kind, merged(kind))

    return (map_arrow(rows, run, "kind int, key long, n long, seen long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))


_SMALL = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1, 511)))])  # ln gamma(n) of integers
_HALF = math.lgamma(0.5) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 511) + 0.5))])  # of n + 1/2


def _ln_gamma_large(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1.0)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def half(n):
        return np.where(n < 500, _HALF[np.minimum(n, 500).astype(np.int64)], _ln_gamma_large(n + 0.5))

    total = n0 + n1
    whole = np.where(total < 500, _SMALL[np.minimum(total, 500).astype(np.int64) + 1], _ln_gamma_large(total + 1.0))
    return half(n0) + half(n1) - math.log(math.pi) - whole


def _share(ln_pe: np.ndarray, ln_deeper: np.ndarray) -> np.ndarray:
    """Posterior share of a node's own estimate against the deeper mixture."""
    return 1 / (1 + np.exp(np.clip(ln_deeper - ln_pe, -700, 700)))


def subtrees(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evaluate the trees from depth DEPTH up to DEALT for whole groups of grams.

    Returns (p[gram, bit level] of the gram's own bit given depths DEALT and
    deeper, the nodes at DEALT, and (ln Pw, n0, n1) of each); a node is its
    context bytes, then the bits of the symbol so far as a heap number.
    """
    symbol = (code & np.uint64(255)).astype(np.int64)
    context = code >> np.uint64(8)
    p = np.zeros((len(code), 8))
    nodes, sums = [], []
    for k in range(8):
        heap = ((1 << k) | (symbol >> (8 - k))).astype(np.uint64)
        bit = (symbol >> (7 - k)) & 1
        deeper = first = ln_pw = None
        for d in range(DEPTH, DEALT - 1, -1):
            node = ((context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | heap
            names, first_now, at = np.unique(node, return_index=True, return_inverse=True)
            ones = np.bincount(at, n * bit, len(names))
            zeros = np.bincount(at, n * (1 - bit), len(names))
            ln_pe = ln_kt(zeros, ones)
            own = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros + ones + 1)[at]
            if d == DEPTH:
                deeper, ln_pw = own, ln_pe
            else:
                below = np.bincount(at[first], ln_pw, len(names))
                share = _share(ln_pe, below)[at]
                deeper = share * own + (1 - share) * deeper
                ln_pw = np.logaddexp(ln_pe, below) - math.log(2)
            first = first_now
        p[:, k] = deeper
        nodes.append(names)
        sums.append(np.column_stack([ln_pw, zeros, ones]))
    return p, np.concatenate(nodes), np.concatenate(sums)


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows that end where the column ``last`` changes."""
    waiting: list[pa.RecordBatch] = []
    size, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size < enough:
            continue
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        last = whole.column("last").to_numpy()
        end = int(np.searchsorted(last, last[-1]))  # the last group may go on
        if end:
            yield whole.slice(0, end)
        waiting, size = [whole.slice(end)], whole.num_rows - end
        enough = max(rows, 2 * size)  # a long group is put together a few times, not at every batch
    if size:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _top(rows) -> dict[str, np.ndarray]:
    """Shares and estimates of depths 1 and 0: [last byte, heap] and [heap]."""
    below, zeros, ones = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        c, heap = r["node"] >> 8, r["node"] & 255
        below[c, heap], zeros[c, heap], ones[c, heap] = r["below"], r["n0"], r["n1"]
    ln_pe = ln_kt(zeros, ones)
    ln_pw = np.logaddexp(ln_pe, below) - math.log(2)
    ln_pw[zeros + ones == 0] = 0
    z, o = zeros.sum(0), ones.sum(0)
    return {"share1": _share(ln_pe, below), "one1": (ones + 0.5) / (zeros + ones + 1),
            "share0": _share(ln_kt(z, o), ln_pw.sum(0)), "one0": (o + 0.5) / (z + o + 1)}


def _level_two(dealt: DataFrame) -> DataFrame:
    """(node, share, one, ln_pw, n0, n1, thirds) of the nodes at depth DEALT - 1.

    ``thirds`` lists the context bytes before them (each once, at most 256).
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            _, key, sums = subtrees(part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *[pa.array(sums[:, i].copy()) for i in range(3)]],
                                             ["node", "ln_pw", "n0", "n1"])

    width = 8 * DEALT  # bits of a node one level up: its context bytes and the heap number
    summed = (map_arrow(dealt, nodes, "node long, ln_pw double, n0 double, n1 double")
              .groupBy(F.col("node").bitwiseAND((1 << width) - 1).alias("node"))
              .agg(F.sum("ln_pw").alias("below"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
                   F.collect_list(F.shiftright("node", width).cast("short")).alias("thirds")))

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below, zeros, ones = (batch.column(c).to_numpy() for c in ("below", "n0", "n1"))
            ln_pe = ln_kt(zeros, ones)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(_share(ln_pe, below)), pa.array((ones + 0.5) / (zeros + ones + 1)),
                 pa.array(np.logaddexp(ln_pe, below) - math.log(2)), batch.column("n0"), batch.column("n1"),
                 batch.column("thirds")], ["node", "share", "one", "ln_pw", "n0", "n1", "thirds"])

    return cut(map_arrow(summed, estimates, "node long, share double, one double, ln_pw double, n0 double, n1 double,"
                                            " thirds array<smallint>"))


def byte_model(table: DataFrame) -> DataFrame:
    """(key, value, seen): log10 probability of the last byte of every gram; ``table``: (key, n, seen).

    Rows meet by the last three context bytes, so no key holds more than 256^3 grams.
    """
    last = F.shiftright("key", 8).bitwiseAND((1 << 8 * DEALT) - 1)
    counts = table.select("key", "n", "seen", last.alias("last"))
    two = _level_two(counts.repartition("last").sortWithinPartitions("last"))
    up = (two.groupBy(F.col("node").bitwiseAND((1 << 8 * (DEALT - 1)) - 1).alias("node"))
          .agg(F.sum("ln_pw").alias("below"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    top = _top(up.collect())  # at most 256 * 255 rows

    # a group's nodes of the level above travel with its grams: key = last bytes and heap number
    third = F.shiftleft(F.col("third").cast("long"), 8 * DEALT).bitwiseOR(F.col("node"))
    above = (two.select("node", "share", "one", F.explode("thirds").alias("third"))
             .select(third.alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("seen"),
                     F.shiftright(third, 8).alias("last"), "share", "one"))
    none = F.lit(None).cast("double")
    both = (counts.withColumns({"share": none, "one": none}).unionByName(above)
            .repartition("last").sortWithinPartitions("last"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            is_gram = pc.is_null(group.column("share"))
            part, two_ = group.filter(is_gram), group.filter(pc.invert(is_gram))
            name = two_.column("key").to_numpy()
            order = np.argsort(name, kind="stable")
            name = name[order]
            share2, one2 = two_.column("share").to_numpy()[order], two_.column("one").to_numpy()[order]
            code = part.column("key").to_numpy().view(np.uint64)
            p, _, _ = subtrees(code, part.column("n").to_numpy().astype(float))
            symbol = (code & np.uint64(255)).astype(np.int64)
            three, byte = part.column("last").to_numpy(), ((code >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            value = np.zeros(len(code))
            for k in range(8):
                heap, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
                at = np.searchsorted(name, (three << 8) | heap)
                q = p[:, k]
                for share, one in ((share2[at], one2[at]), (top["share1"][byte, heap], top["one1"][byte, heap]),
                                   (top["share0"][heap], top["one0"][heap])):
                    q = share * np.where(bit == 1, one, 1 - one) + (1 - share) * q
                value += np.log10(q)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(value), part.column("seen")], ["key", "value", "seen"])

    return map_arrow(both, values, "key long, value double, seen long")


def frequent(table: DataFrame, entries: int) -> DataFrame:
    """The rows of ``table`` seen most often, at most ``entries`` of them: all
    rows from a frequency on, which a small histogram gives."""
    step = F.floor(F.log2(F.col("seen").cast("double")) * 8)
    room, least = entries, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > room:
            break
        room -= r["n"]
        least = r["step"]
    return table.filter(F.lit(False)) if least is None else table.filter(step >= least)


class Lookup:
    """Open addressing over 64-bit keys, filled at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.values = np.asarray(values, np.float64)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        self.reach = 0
        while len(rest):
            self.reach += 1
            free = self.at[slot] < 0
            self.at[slot[free]] = rest[free]  # of several, one stays
            done = free & (self.at[slot] == rest)
            self.keys[slot[done]] = keys[rest[done]]
            rest, slot = rest[~done], (slot[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found) of each key."""
        slot = self._slot(keys)
        entry = np.where(self.keys[slot] == keys, self.at[slot], -1)
        open_ = np.flatnonzero((entry < 0) & (self.at[slot] >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            s = (slot[open_] + step) & self.mask
            hit = (self.keys[s] == keys[open_]) & (self.at[s] >= 0)
            entry[open_[hit]] = self.at[s[hit]]
            open_ = open_[~hit & (self.at[s] >= 0)]
        found = entry >= 0
        return np.where(found, self.values[np.maximum(entry, 0)] if len(self.values) else 0.0, 0.0), found


def _lookup(table: DataFrame, column: str, entries: int) -> Lookup:
    rows = frequent(table, entries).select("key", F.col(column).cast("double").alias("v")).toArrow()
    return Lookup(rows["key"].to_numpy().view(np.uint64).copy(), rows["v"].to_numpy().copy())


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``held_out`` isn't true, score all.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte): base_score is the add-one unigram score of the
    words, score the log10 probability of the text's bytes and its end.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    ends = rows.filter("NOT held_out").count()
    table = cut(counted(rows.select("t", (~F.col("held_out")).alias("train"))))
    words = table.filter(F.col("kind") == WORD).drop("kind")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, n_types = total["n"] + ends, total["v"] + (ends > 0)
    bytes_ = cut(byte_model(table.filter(F.col("kind") == GRAM).drop("kind")))
    model = spark.sparkContext.broadcast((_lookup(bytes_, "value", HEAD), _lookup(words, "n", HEAD_WORDS)))
    scale = math.log10(n_train + n_types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_table, word_table = model.value
        for batch in batches:
            for part in T.slices(batch, "t"):
                m = part.num_rows
                code, n_code = grams(part.column("t"))
                of_code = np.repeat(np.arange(m), n_code)
                value, found = byte_table(code)
                total = np.bincount(of_code, value, m).astype(float)
                words_, n_word, names = T.words(part.column("t"))
                of_word = np.repeat(np.arange(m), n_word)
                hashed = T.hash_strings(names.to_pylist())
                c, known = word_table(hashed)
                seen = known[words_] if len(words_) else np.zeros(0, bool)
                count = c[words_[seen]] if len(words_) else np.zeros(0)
                base = np.bincount(of_word[seen], np.log10(count + 1) - scale, m).astype(float)
                n_known = np.bincount(of_word[seen], count > 0, m).astype(np.int64)
                # everything that isn't in the broadcast tables, counted per text
                miss_code, miss_word = code[~found], (hashed[words_[~seen]] if len(words_) else np.zeros(0, np.uint64))
                of = np.concatenate([of_code[~found], of_word[~seen]])
                kind = np.concatenate([np.zeros(len(miss_code), np.int64), np.ones(len(miss_word), np.int64)])
                key = np.concatenate([miss_code, miss_word])
                order = np.lexsort((key, kind, of))
                of, kind, key = of[order], kind[order], key[order]
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]) if len(of) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(of)))
                rest = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of[new], np.arange(m + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(kind[new].astype(np.int32)), pa.array(T.signed(key[new].copy())),
                                                pa.array(times.astype(np.int64))], ["kind", "key", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("row"), pa.array(n_word + 1), pa.array(n_known),
                     pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(n_code - 1), rest],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "total", "n_bytes", "rest"])

    ident = rows.schema["doc_id"].dataType.simpleString()
    path = scratch(spark, "ctw")
    map_arrow(rows.withColumn("row", F.monotonically_increasing_id()), run,
              f"doc_id {ident}, held_out boolean, row long, n_tokens long, n_known long, base double, total double,"
              " n_bytes long, rest array<struct<kind: int, key: long, times: long>>").write.parquet(path)
    scored = spark.read.parquet(path)
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    values = (words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"))
              .unionByName(bytes_.select(F.lit(GRAM).alias("kind"), "key", "value")))
    is_word = F.col("kind") == WORD
    times, value = F.col("times"), F.col("value")
    tail = (rest.join(values, ["kind", "key"])
            .groupBy("row").agg(
                F.sum(F.when(is_word, times * (F.log10(value + 1) - F.lit(scale))).otherwise(0.0)).alias("base_rest"),
                F.sum(F.when(is_word & (value > 0), times).otherwise(0)).alias("known_rest"),
                F.sum(F.when(~is_word, times * value).otherwise(0.0)).alias("total_rest")))
    none = F.lit(0.0)
    out = (scored.drop("rest").join(tail, "row", "left")
           .withColumn("score", F.col("total") + F.coalesce("total_rest", none)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known_rest", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", none) + F.lit(math.log10(ends + 1) - scale)).alias("base_score"),
        "score", "n_bytes",
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
