"""Licence scans by a positional rare-token index, in DataFrame operations only.

The licences (``licence_texts``) are whole licence texts and notices, short
references, names and SPDX tags, each with a label and a mandatory key phrase. A whole
text is cut into segments of SEGMENT words, so a changed or inserted word costs
one segment and not what follows it. The document frequency of every licence
word is counted over all documents; of each segment the RARE words with the
highest idf, at most half of its words, are indexed with their positions, so
that no word that every text holds is looked up. Per file every indexed word it
holds is looked up (the licences bound their number): every occurrence votes,
through the postings, for an alignment (segment, file position - segment
position). An alignment with votes of at least VOTES different segment words
(all of them if the segment has fewer indexed words) is verified on the words
themselves: the share of segment words at their places must reach COVER, and
the key phrase, if it begins in this segment, must stand where the text has it.
A licence is found if the segment with its key phrase is, and if at least SHARE
of its words stand in place in the segments found; that share is its score, and
the score of a file is its best one.

All steps work on the arrays of one row, so no shuffle follows the count, and
files without any indexed word stop after one look at their words.

Base phrases are found by their words standing consecutively.

Words: runs of digits, letters and anything beyond ASCII, lower-cased.
Defined cases: null text has no words, no labels and score 0; equal idf is
ordered by word; repeated rows are alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import licence_texts

RARE = 6
VOTES = 2
COVER = 0.75
SEGMENT = 20
SHARE = 0.5

#: Phrases and labels of the base (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Segment(NamedTuple):
    licence: int
    words: list[str]
    key: list[str]  # the key phrase, if it begins in this segment
    place: int      # and where it does
    alone: bool     # nothing else may stand in the text


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def _cut(licence: int, text: str, phrase: str, alone: bool) -> list[Segment]:
    """The segments of one text; a short rest belongs to the last one."""
    words, key = _plain(text), phrase.split()
    place = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
    ends = [*range(SEGMENT, len(words) - SEGMENT // 2, SEGMENT), len(words)]
    return [Segment(licence, words[a:b], key if a <= place < b else [], place - a if a <= place < b else 0, alone)
            for a, b in zip([0, *ends], ends)]


def _all(forms: str, pairs) -> list[tuple[str, str, str]]:
    return [(label, forms.format(name), forms.format(name)) for label, name in pairs]


_ALONE = _all("{}", licence_texts.NAMES)
#: (label, text, mandatory key phrase)
TEMPLATES = (*licence_texts.WHOLE, *licence_texts.SHORT, *_all("spdx license identifier {}", licence_texts.SPDX),
             *_all("{} copyright", licence_texts.NAMES), *_all("under the {}", licence_texts.NAMES), *_ALONE)
SEGMENTS = [x for i, (_, text, phrase) in enumerate(TEMPLATES) for x in _cut(i, text, phrase, i >= len(TEMPLATES) - len(_ALONE))]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    # lower() also maps letters beyond ASCII; that changes no word boundary and no ASCII phrase
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<int>")


def _word_lists(values: list[list[str]]) -> Column:
    return F.array(*[F.filter(F.split(F.lit(" ".join(v)), " "), lambda x: x != "") for v in values])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Number of documents per licence word (a fixed set of words)."""
    vocabulary = sorted({w for s in SEGMENTS for w in s.words})
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def build_index(frequencies: dict[str, int], n_docs: int) -> tuple[dict[str, float], dict[str, list[tuple[int, int]]]]:
    """(idf of the indexed words, their postings (segment, position))."""
    idf = {w: math.log((1 + n_docs) / (1 + n)) for w, n in frequencies.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, segment in enumerate(SEGMENTS):
        names = sorted(set(segment.words), key=lambda w: (-idf[w], w))
        rare = names[:min(RARE, (len(names) + 1) // 2)]
        for p, w in enumerate(segment.words):
            if w in rare:
                postings.setdefault(w, []).append((t, p))
    return {w: idf[w] for w in postings}, postings


def _base_places(w: Column) -> list[Column]:
    """Start positions of each base phrase."""

    def places(phrase: str) -> Column:
        parts = phrase.split()

        def here(x: Column, i: Column) -> Column:
            ok = x == parts[0]
            for k, part in enumerate(parts[1:], 1):
                ok = ok & F.coalesce(F.get(w, i + k) == part, F.lit(False))
            return ok

        marked = F.transform(w, lambda x, i: F.when(here(x, i), i))
        return F.filter(marked, lambda i: i.isNotNull())

    return [F.when(F.array_contains(w, phrase.split()[-1]), places(phrase)).otherwise(F.array().cast("array<int>"))
            for phrase, _ in BASE]


def _alignments(w: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Verified (segment, offset, number of words in place) of one file's words."""
    indexed = sorted(postings)
    post = F.create_map(*[x for k in indexed for x in (
        F.lit(k), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[k]]))])
    segments = _word_lists([s.words for s in SEGMENTS])
    known: dict[int, set[str]] = {}
    for k in indexed:
        for t, _ in postings[k]:
            known.setdefault(t, set()).add(k)
    needed = _numbers([min(VOTES, len(known[t])) for t in range(len(SEGMENTS))])
    alone = _numbers([int(s.alone) for s in SEGMENTS])
    phrases, at = _word_lists([s.key for s in SEGMENTS]), _numbers([s.place for s in SEGMENTS])
    held = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(indexed))

    def voted(h: Column) -> Column:
        votes = F.flatten(F.transform(h, lambda x: F.transform(
            F.try_element_at(post, x["w"]),
            lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("o"), p["p"].alias("p")))))
        return F.sort_array(F.array_distinct(votes))

    def runs(v: Column) -> Column:
        """(segment, offset, votes) from the sorted votes."""
        begins = F.filter(F.transform(v, lambda x, i: F.struct(x["t"].alias("t"), x["o"].alias("o"), i.alias("i"))),
                          lambda x: (x["i"] == 0) | (F.get(v, F.greatest(x["i"] - 1, F.lit(0)))["t"] != x["t"])
                          | (F.get(v, F.greatest(x["i"] - 1, F.lit(0)))["o"] != x["o"]))
        return let(begins, lambda b: F.transform(b, lambda x, k: F.struct(
            x["t"].alias("t"), x["o"].alias("o"), (F.coalesce(F.get(b, k + 1)["i"], F.size(v)) - x["i"]).alias("n"))))

    def checked(c: Column) -> Column:
        t, o = c["t"], c["o"]
        words = F.get(segments, t)
        same = F.size(F.filter(F.transform(words, lambda x, i: F.coalesce(x == F.get(w, o + i), F.lit(False))), lambda x: x))
        key, place = F.get(phrases, t), F.get(at, t)
        holds = F.forall(F.transform(key, lambda x, i: F.coalesce(x == F.get(w, o + place + i), F.lit(False))), lambda x: x)
        return F.struct(t.alias("t"), o.alias("o"), same.alias("same"),
                        (holds & (same / F.size(words) >= COVER)
                         & ((F.get(alone, t) == 0) | (F.size(w) == F.size(words)))).alias("ok"))

    candidates = let(let(held, voted), lambda v: F.filter(runs(v), lambda c: c["n"] >= F.get(needed, c["t"])))
    return F.filter(F.transform(candidates, checked), lambda c: c["ok"])


def _found(alignments: Column) -> Column:
    """(licence, share of its words in place) of the licences found."""
    licence_of = _numbers([s.licence for s in SEGMENTS])
    has_key = _numbers([int(bool(s.key)) for s in SEGMENTS])
    size = [0] * len(TEMPLATES)
    for s in SEGMENTS:
        size[s.licence] += len(s.words)
    sizes = _numbers(size)

    def judged(a: Column) -> Column:
        def of(licence: Column) -> Column:
            return let(F.filter(a, lambda x: F.get(licence_of, x["t"]) == licence), lambda own: F.struct(
                licence.alias("licence"), F.exists(own, lambda x: F.get(has_key, x["t"]) == 1).alias("key"),
                # a segment found at several places counts by its best one
                (F.aggregate(F.array_distinct(F.transform(own, lambda x: x["t"])), F.lit(0), lambda n, t: n + F.array_max(
                    F.transform(F.filter(own, lambda x: x["t"] == t), lambda x: x["same"])))
                 / F.get(sizes, licence)).alias("share")))

        return F.filter(F.transform(F.array_distinct(F.transform(a, lambda x: F.get(licence_of, x["t"]))), of),
                        lambda x: x["key"] & (x["share"] >= SHARE))

    return let(alignments, judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row."""
    n_docs = docs.count()
    _, postings = build_index(document_frequencies(docs, text_col), n_docs)
    labels_of = _strings([label for label, _, _ in TEMPLATES])
    anchors = _strings(sorted({*postings, *(p.split()[-1] for p, _ in BASE)}))
    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"),
                    F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base"),
                    F.array().cast("array<string>").alias("all"), F.lit(0.0).alias("score"))

    def body(w: Column) -> Column:
        def merged(found: Column) -> Column:
            places = [F.get(found, F.lit(i)) for i in range(len(BASE))]
            every = F.flatten(found)
            base = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, BASE)]),
                            lambda x: x.isNotNull())
            return let(_found(_alignments(w, postings)), lambda a: F.struct(
                F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                F.array_max(every).cast("long").alias("last_word"), F.sort_array(F.array_distinct(base)).alias("base"),
                F.sort_array(F.array_distinct(F.concat(base, F.transform(a, lambda x: F.get(labels_of, x["licence"]))))).alias("all"),
                F.coalesce(F.array_max(F.transform(a, lambda x: x["share"])),
                           F.when(F.size(every) > 0, F.lit(1.0)), F.lit(0.0)).alias("score")))

        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.when(F.arrays_overlap(w, anchors), let(F.array(*_base_places(w)), merged)).otherwise(none).alias("x"))

    return (docs.select(F.col(id_col).alias("doc_id"), let(words_of(F.col(text_col)), body).alias("r"))
            .select("doc_id", "r.n_words", "r.x.n_base", "r.x.first_word", "r.x.last_word",
                    F.array_join("r.x.base", ",").alias("base_labels"), F.array_join("r.x.all", ",").alias("labels"),
                    "r.x.score"))
