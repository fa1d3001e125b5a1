"""Benchmark decontamination by template canonicalisation.

Words are case-folded and stripped of edge punctuation; numbers, names and
units become typed placeholders (<num>, <name>, <unit>) and their values are
kept as slots. Windows of WINDOW template words of all documents are
hash-joined with those of the benchmark. Matching windows of one document and
item line up to alignments: runs of consecutive windows, chained in the order
of both texts, where a step from one run to the next may insert or leave out
at most as many words as the item has. So inserted, missing and replaced words
split an item into several runs of one alignment. An alignment counts if its
slots are consistent - one benchmark value always stands for the same document
value and the other way round, over the whole alignment - and it covers at
least COVER of the item's windows, or its windows hold at least COVER_WORDS of
the item's words (an edit takes up to WINDOW windows from a short item but few
words), or it holds VERBATIM consecutive words of the item unchanged, whatever
share of the item they are. So copies, edited copies,
excerpts and re-parameterised questions are found, and chance overlaps of
templates are not. Where a chain is not consistent, its windows at one
distance count alone if they reach COVER of those with a template.

* number: a token with a digit and otherwise only digits and ., : / % + - or
  currency signs.
* unit: a token of UNITS directly after a number.
* name: a token that starts with an upper-case letter, is not all upper-case
  beyond one letter, and follows a token that doesn't end a sentence; the
  first token of a text or line is no name.

Wording that many items share (an instruction, a form's text) is no evidence
for any of them: places of an item whose words stand in more than SHARED items
of different text are left out, of the item's windows and of what COVER and
COVER_WORDS are shares of. An item with no other place keeps them all.

Every window is also joined on the hash of its case-folded words, so copies in
another case are found although names are told by their capital. Windows with
fewer than CONTENT words that are no placeholders (names, tables of numbers)
match in this way only: their templates alone are too common. COVER is a share
of the windows with at least CONTENT such words, or of all windows.
An item with fewer than WINDOW words gives one window of all its words (at
least SHORTEST words; by its template only if at least half are no
placeholders); shorter items cannot be told from chance and match nothing.

Before the join, documents' windows pass a filter of 2^24 bits that
holds all benchmark windows. Its size is fixed, so it can be broadcast
whatever the benchmark's size; it only saves shuffling, the join decides.

Defined cases: null or blank texts (either side) match nothing; repeated
items or rows give repeated results only through their ids, which may be of
any type; extra columns are ignored, whatever their names. Every (document, item) pair is returned once, with its best alignment;
texts that share an id are aligned one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._filter import bit_filter, passes, unpacked
from feira.llm._ship import map_arrow
from feira.llm._store import cut

WINDOW = 8
CONTENT = 4
SHORTEST = 4
COVER = 0.5
COVER_WORDS = 0.75
VERBATIM = 13
SHARED = 3

#: Unit words (fixed values).
UNITS = frozenset("""mm cm m km in ft yd mi mile miles g kg mg lb lbs oz ton tons l ml s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent
degree degrees c f k hz khz mhz ghz w kw mw v a b kb mb gb tb""".split())

_NUMBER = re.compile(r"^[0-9.,:/%+\-$€£¥]*[0-9][0-9.,:/%+\-$€£¥]*$")
_EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’…"
NUM, NAME, UNIT = (np.uint64(x) for x in (0x51ED270B27A1C3D5, 0x93C467E37DB0C7A5, 0xD1B54A32D192ED03))
_WORD, _IS_NUM, _IS_UNIT, _IS_CAP, _ENDS = 0, 1, 2, 4, 8


def _kinds(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the bare case-folded word, flags) of every distinct token."""
    bare = [v.strip(_EDGE) for v in vocabulary]
    flags = np.zeros(len(vocabulary), np.int64)
    for i, (v, b) in enumerate(zip(vocabulary, bare)):
        f = 0
        if _NUMBER.match(b):
            f |= _IS_NUM
        if b.lower() in UNITS:
            f |= _IS_UNIT
        if b[:1].isupper() and not (len(b) > 1 and b.isupper()):
            f |= _IS_CAP
        if v.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", "…"):
            f |= _ENDS
        flags[i] = f
    return T.hash_strings([b.casefold() for b in bare]), flags


def _template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash, is a slot, words per text), word by word."""
    marked = pc.replace_substring_regex(T.plain(texts), r"[\n\r]+", " \x01 ")
    codes, counts, vocabulary = T.words(marked, lower=False)
    names = vocabulary.to_pylist()
    value, flags = _kinds(names)
    line = np.fromiter((v == "\x01" for v in names), bool, len(names))
    text = np.repeat(np.arange(len(counts)), counts)
    # a line mark is no word, but the word after it starts a sentence
    is_line = line[codes]
    begins = np.ones(len(codes), bool)
    if len(codes) > 1:
        begins[1:] = is_line[:-1] | (text[1:] != text[:-1]) | (flags[codes[:-1]] & _ENDS > 0)
    empty = np.fromiter((not v.strip(_EDGE) for v in names), bool, len(names))[codes] & ~is_line
    keep = ~is_line & ~empty
    codes, text, begins = codes[keep], text[keep], begins[keep]
    counts = np.bincount(text, minlength=len(counts)).astype(np.int64)
    f = flags[codes]
    number = f & _IS_NUM > 0
    unit = np.zeros(len(codes), bool)
    if len(codes) > 1:
        unit[1:] = (f[1:] & _IS_UNIT > 0) & number[:-1] & (text[1:] == text[:-1])
    name = (f & _IS_CAP > 0) & ~begins & ~number & ~unit
    values = value[codes]
    template = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, values)))
    return template, values, number | unit | name, counts


def _content(width: int) -> int:
    """Words that are no placeholders in a window that is joined by its template."""
    return CONTENT if width == WINDOW else (width + 1) // 2


def _windows(template, values, slot, counts, width) -> tuple[np.ndarray, ...]:
    """(template hash, hash of the words, text, position, words that are no slots) of each window."""
    h, text, at = T.rolling(template, counts, width)
    if not len(h):
        return h, h, text, at, at
    plain_h, _, _ = T.rolling(values, counts, width)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    plain = np.concatenate([[0], np.cumsum(~slot)])
    start = first[text] + at
    return h, plain_h, text, at, plain[start + width] - plain[start]


def _slots(values, slot, start: int, width: int) -> list[int]:
    w = np.flatnonzero(slot[start:start + width])
    return T.signed(np.column_stack([w.astype(np.uint64), values[start + w]]).ravel().copy()).tolist()


_SCHEMA = "id string, row long, width int, hash long, plain boolean, pos long, slots array<long>"


def _emit(part: pa.RecordBatch, rows: list[tuple], more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row per window; ``more`` has values per text."""
    at = pa.array([r[0] for r in rows], pa.int64())
    out = {"id": part.column("id").take(at), "row": part.column("row").take(at),
           "width": pa.array([r[1] for r in rows], pa.int32()), "hash": pa.array([r[2] for r in rows], pa.int64()),
           "plain": pa.array([r[3] for r in rows], pa.bool_()), "pos": pa.array([r[4] for r in rows], pa.int64()),
           "slots": pa.array([r[5] for r in rows], pa.list_(pa.int64()))}
    out |= {name: pa.array(v, pa.int64()).take(at) for name, v in (more or {}).items()}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """All windows of the benchmark by template and by words (``plain``), with the
    item's windows, those that have a template, and words; ``items``: (id, row, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                template, values, slot, counts = _template(part.column("t"))
                first = np.concatenate([[0], np.cumsum(counts)])
                rows, total, typed = [], np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                for n in range(SHORTEST, WINDOW + 1):
                    h, plain, text, at, content = _windows(template, values, slot, counts, n)
                    own = (n == WINDOW) | (counts[text] == n)
                    total += np.bincount(text[own], minlength=len(counts))
                    typed += np.bincount(text[own & (content >= _content(n))], minlength=len(counts))
                    # without slots, the template is the words
                    for hashes, some, by_words in ((h, own & (content >= _content(n)) & (content < n), False), (plain, own, True)):
                        for x, i, p in zip(T.signed(hashes[some]).tolist(), text[some].tolist(), at[some].tolist()):
                            rows.append((i, n, x, by_words, p, _slots(values, slot, first[i] + p, n)))
                yield _emit(part, rows, {"total": total, "typed": typed, "words": counts})

    return map_arrow(items, run, f"{_SCHEMA}, total long, typed long, words long")


def distinctive(bench: DataFrame) -> DataFrame:
    """The windows at places whose words stand in at most SHARED items, with
    ``total`` and ``typed`` counted anew and ``need``, the words that
    COVER_WORDS is a share of; all windows of items that have no such place."""
    plain = bench.filter("plain")
    items = plain.groupBy("width", "hash").agg(F.count_distinct("row").alias("items"))
    places = (plain.join(items, ["width", "hash"]).groupBy("row", "pos").agg((F.max("items") > SHARED).alias("shared")))
    own = places.groupBy("row").agg(F.count_if(~F.col("shared")).alias("own"), F.count("*").alias("places"))
    kept = bench.join(places, ["row", "pos"]).join(own, "row").filter(~F.col("shared") | (F.col("own") == 0))
    typed = kept.filter("NOT plain").groupBy("row").agg(F.count_distinct("pos").alias("own_typed"))
    some = F.col("own") > 0
    return (kept.join(typed, "row", "left")
            .withColumn("total", F.when(some, F.col("own")).otherwise(F.col("total")))
            .withColumn("typed", F.when(some & (F.col("own") < F.col("places")), F.coalesce("own_typed", F.lit(0).cast("long")))
                        .otherwise(F.col("typed")))
            .withColumn("need", F.when(some, F.col("words") * F.col("own") / F.col("places")).otherwise(F.col("words").cast("double")))
            .select("id", "row", "width", "hash", "plain", "pos", "slots", "total", "typed", "words", "need"))


def document_windows(docs: DataFrame, packed, widths: list[int]) -> DataFrame:
    """The windows of ``docs`` (id, row, t) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(packed.value)
        for batch in batches:
            for part in T.slices(batch, "t"):
                template, values, slot, counts = _template(part.column("t"))
                first = np.concatenate([[0], np.cumsum(counts)])
                rows = []
                for n in widths:
                    h, plain, text, at, content = _windows(template, values, slot, counts, n)
                    for hashes, some, by_words in ((h, (content >= _content(n)) & (content < n), False), (plain, True, True)):
                        hit = np.flatnonzero(passes(bits, hashes) & some)
                        for x, i, p in zip(T.signed(hashes[hit]).tolist(), text[hit].tolist(), at[hit].tolist()):
                            rows.append((i, n, x, by_words, p, _slots(values, slot, first[i] + p, n)))
                if rows:
                    yield _emit(part, rows)

    return map_arrow(docs, run, _SCHEMA)


def _runs(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(offset, first, last item position) of the runs of consecutive windows, by first position."""
    out: list[list[int]] = []
    for offset, i in sorted((d - i, i) for i, d in points):
        if out and out[-1][0] == offset and out[-1][2] == i - 1:
            out[-1][2] = i
        else:
            out.append([offset, i, i])
    return sorted(((o, a, b) for o, a, b in out), key=lambda r: (r[1], r[0]))


def _chain(runs: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int]]:
    """The windows (item, document position) of the chain of ``runs`` with most windows."""
    best: list[tuple[int, int, int]] = []  # (windows, first position used, run before or -1)
    at: dict[int, list[int]] = {}
    for k, (o, a, b) in enumerate(runs):
        top = (b - a + 1, a, -1)
        for other in (range(o - reach, o + reach + 1) if len(at) > 2 * reach else [x for x in at if abs(x - o) <= reach]):
            for j in at.get(other, ()):
                last = runs[j][2]
                start = max(a, last + 1, last + other + 1 - o)  # later in the item and in the document
                if start <= b and best[j][0] + b - start + 1 > top[0]:
                    top = (best[j][0] + b - start + 1, start, j)
        best.append(top)
        at.setdefault(o, []).append(k)
    k, out = max(range(len(runs)), key=lambda x: (best[x][0], -x)), []
    while k >= 0:
        out += [(i, i + runs[k][0]) for i in range(best[k][1], runs[k][2] + 1)]
        k = best[k][2]
    return out


def _alignment(used: list[tuple[int, int]], points: dict[tuple[int, int], bool], islots: dict[int, list[int]],
               slots: dict[int, list[int]], total: int, typed: int, words: int, need: float) -> tuple[int, int, int, int] | None:
    """(windows, item windows, slots, changed) of the windows ``used``, None if they do not count.

    ``points`` says of each window whether its words are the item's. Counted
    are the windows with a template (``typed`` in all) if these reach COVER,
    else all."""
    width = min(WINDOW, words)
    known = sum(width - len(islots[i]) // 2 >= _content(width) for i, _ in used)
    by_template = typed > 0 and known >= COVER * typed
    if not by_template and len(used) < COVER * total:
        held = {i + k for i, _ in used for k in range(width)}
        same = [p for p in used if points[p]]
        if len(held) < COVER_WORDS * need and max((b - a + 1 for _, a, b in _runs(same)), default=0) < VERBATIM - WINDOW + 1:
            return None
    pairs = set()
    for p in used:
        own = islots[p[0]][1::2]
        pairs.update(zip(own, own if points[p] else slots[p[1]][1::2]))
    if not len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
        return None
    return *((known, typed) if by_template else (len(used), total)), len(pairs), sum(a != b for a, b in pairs)


def _best(points: dict[tuple[int, int], bool], islots: dict[int, list[int]], slots: dict[int, list[int]],
          total: int, typed: int, words: int, need: float) -> tuple[int, int, int, int] | None:
    """The best alignment of one document and item."""
    found = []
    least = min(COVER * total, COVER * typed if typed else total, VERBATIM - WINDOW + 1, COVER_WORDS * need / WINDOW)
    near: list[set[tuple[int, int]]] = []  # no chain goes over more than 2 * words words without a window
    for d, i in sorted((d, i) for i, d in points):
        if not near or d - end > 2 * words:
            near.append(set())
        near[-1].add((i, d))
        end = d
    for left in near:
        while left and len(left) >= least:
            used = _chain(_runs(list(left)), words)
            one = _alignment(used, points, islots, slots, total, typed, words, need) if len(used) >= least else None
            if one or len(used) < least:
                found += [one] if one else []
                break  # later chains are shorter
            left -= set(used)
    line: dict[int, list[tuple[int, int]]] = {}
    for i, d in points:
        line.setdefault(d - i, []).append((i, d))
    alone = (_alignment(used, points, islots, slots, total, typed, words, need) for used in line.values() if len(used) >= least)
    found += [x for x in alone if x and x[1] == typed and x[0] >= COVER * typed]
    return max(found, key=lambda x: (x[0], -x[3]), default=None)


_KEY = ["doc_id", "doc_row", "item_id", "item_row"]
_POINT = ["plain", "ipos", "pos", "islots", "slots", "total", "typed", "words", "need"]


def _aligned(pairs: DataFrame) -> DataFrame:
    """Alignments of (document, item) pairs from their matching windows, one pair after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, points, islots, slots, sizes = None, {}, {}, {}, ()

        def out() -> list[tuple]:
            best = _best(points, islots, slots, *sizes) if last is not None else None
            return [(last[0], last[1], last[2], *best)] if best else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                              ["doc_id", "doc_row", "item_id", "windows", "item_windows", "slots", "changed"])

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in (*_KEY, *_POINT)]
            for *key, plain, i, d, own, other, total, typed, words, need in zip(*columns):
                if key != last:
                    rows += out()
                    last, points, islots, slots, sizes = key, {}, {}, {}, (total, typed, words, need)
                points[i, d] = points.get((i, d), False) or plain
                islots.setdefault(i, own)
                slots.setdefault(d, other)
            if rows:
                yield batch_of(rows)
        rows = out()
        if rows:
            yield batch_of(rows)

    return map_arrow(pairs.repartition(*_KEY).sortWithinPartitions(*_KEY), run,
                     "doc_id string, doc_row long, item_id string, windows long, item_windows long, slots long, changed long")


def _alignments(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The alignments of ``_aligned``, ids as text; ``doc_row`` is the hash of the document's text."""
    spark = docs.sparkSession

    def slim(df: DataFrame, ident: str, text: str) -> DataFrame:
        return df.select(F.col(f"`{ident}`").cast("string").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("row"),
                         F.col(f"`{text}`").alias("t"))

    bench = cut(distinctive(cut(benchmark_windows(slim(benchmark, item_col, item_text_col)))))
    packed = spark.sparkContext.broadcast(bit_filter(bench))
    widths = sorted({r["width"] for r in bench.select("width").distinct().collect()})  # at most WINDOW - SHORTEST + 1 values
    found = document_windows(slim(docs, id_col, text_col), packed, widths)
    b = bench.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "width", "hash", "plain", F.col("pos").alias("ipos"),
                     F.col("slots").alias("islots"), "total", "typed", "words", "need")
    pairs = (found.join(b, ["width", "hash", "plain"])
             .select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "item_id", "item_row", *_POINT))
    return _aligned(pairs)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, slots, changed) of every leak; ids of any type.

    ``slots`` is the number of distinct slot values of the alignment,
    ``changed`` how many of them differ from the benchmark's (0: a copy).
    """
    best = (_alignments(docs, benchmark, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "item_id")
            .agg(F.max_by(F.struct("windows", "item_windows", "slots", "changed"),
                          F.struct("windows", -F.col("changed"))).alias("best")))
    return best.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
                       F.col("item_id").cast(benchmark.schema[item_col].dataType).alias("item_id"), "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose text matches an item. The text
    alone decides: all rows with it go, whatever their id (also a null one),
    and another text under the same id stays."""
    leaks = _alignments(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("doc_row").alias("leak")).distinct()
    return docs.join(leaks, F.xxhash64(docs[f"`{text_col}`"]) == leaks["leak"], "left_anti")
