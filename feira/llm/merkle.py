"""Merkle manifest of a dataset, with a witness for every row.

A row's leaf is the digest of its fields. Per source the leaves, ascending by
id, are the bottom of a tree in which every FAN consecutive nodes become their
digest until one node, the subroot, is left; the subroots, ordered by source
(null first), are the leaves of a tree of the same form whose top is the root.

Built by appending, never by holding a tree:

* Leaves get their positions from a range sort (``_order.positions``), and
  every FAN^LEVELS consecutive leaves of a source are an aligned block. Blocks
  are independent: each is appended leaf by leaf in one task (``Subtree``). A
  leaf starts with an empty witness; whenever the run that it, or a subtree
  above it, belongs to is complete, the witness grows by the other nodes of
  that run. What is kept is one piece per node, which the leaves below share.
* A block's root is a further append: the block roots of a source are dealt
  into aligned blocks of their own, and so on until each source has one node.
  Each pass has 1 / FAN^LEVELS of the rows of the pass before.
* Witnesses come down the same way: a block's root hands the rest of the path
  to its block, once per block, and the block's leaves join their own pieces
  to it. Full witnesses exist only while a row is checked.

``check`` folds a presented leaf (what a reader has now) with the witness of
the original and compares the result with the root.

Defined cases: a null field is ``-``; a null id sorts first; rows with one id
are ordered by their leaves, and equal rows are interchangeable; a null source
is a source of its own, not the empty one; an empty table has no rows and no
root; a row whose siblings are none (one row in all) has the digest of nothing
as its proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from feira.llm._order import positions
from feira.llm._ship import map_arrow
from feira.llm._store import cut

FAN = 16
LEVELS = 2
SPAN = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Node:
    """A digest; once its run is complete, also what stands before and after it and the node above."""

    __slots__ = ("digest", "before", "after", "above")

    def __init__(self, digest: str):
        self.digest, self.before, self.after, self.above = digest, "", "", None

    def witness(self) -> list[str]:
        """[before, after] of each level up to the top of the subtree, flat."""
        out, node = [], self
        while node.above is not None:
            out += (node.before, node.after)
            node = node.above
        return out


class Subtree:
    """An aligned block, appended node by node; ``open`` holds the unfinished run of each level."""

    def __init__(self, first: bool):
        self.first = first  # the block at the start of its tree may be all of it
        self.open: list[list[Node]] = [[] for _ in range(LEVELS + 1)]
        self.made = [0] * (LEVELS + 1)

    def append(self, node: Node, level: int = 0) -> None:
        run = self.open[level]
        run.append(node)
        self.made[level] += 1
        if len(run) == FAN and level < LEVELS:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.open[level]
        joined = "".join(node.digest for node in run)
        above = Node(_digest(joined))
        for i, node in enumerate(run):
            node.before, node.after, node.above = joined[:64 * i], joined[64 * (i + 1):], above
        self.open[level] = []
        self.append(above, level + 1)

    def root(self) -> Node:
        """The top, after the last append. A tree that ends in this block stops
        at one node; any other block is raised all LEVELS, even a single node."""
        for level in range(LEVELS):
            if self.first and self.made[level] == 1:
                return self.open[level][0]
            if self.open[level]:
                self._complete(level)
        return self.open[LEVELS][0]


def fold(digest: str, witness: list[str]) -> str:
    """The root that ``digest`` leads to along a witness."""
    for before, after in zip(witness[::2], witness[1::2]):
        digest = _digest(before + digest + after)
    return digest


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block), which arrive sorted; a group has SPAN rows and a witness row at most."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _built(rows: list[dict]) -> tuple[list[Node], Node]:
    tree, nodes = Subtree(rows[0]["block"] == 0), [Node(r["digest"]) for r in rows]
    for node in nodes:
        tree.append(node)
    return nodes, tree.root()


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, digest) of the blocks of nodes (tree, pos, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0]["tree"]]), pa.array([rows[0]["block"]], pa.int64()), pa.array([_built(rows)[1].digest])],
                ["tree", "pos", "digest"])

    dealt = (nodes.select("tree", F.floor(F.col("pos") / SPAN).alias("block"), "pos", "digest")
             .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"))
    return map_arrow(dealt, run, "tree string, pos long, digest string")


def passes(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their block roots, the block roots of those, ...: the last table has one node for each tree."""
    out, top = [nodes], nodes.agg(F.max("pos")).first()[0]
    while top:
        out.append(cut(block_roots(out[-1])))
        top //= SPAN
    return out


def _with_witness(nodes: DataFrame, above: DataFrame, carried: Column) -> DataFrame:
    """Node rows and, first in each block, the row of the block's own root in ``above``."""
    rows = nodes.select("tree", F.floor(F.col("pos") / SPAN).alias("block"), "pos", "digest", carried.alias("carried"))
    blank = F.lit(None).cast(rows.schema["carried"].dataType).alias("carried")
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"),
                         F.lit(None).cast("string").alias("digest"), blank, "subroot", "witness")
    return (rows.unionByName(heads, allowMissingColumns=True)
            .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"))


def _witnessed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, list[str]]]:
    """(node row, subroot, whole witness) block by block."""
    for head, *rows in _grouped(batches):
        nodes, _ = _built(rows)
        for row, node in zip(rows, nodes):
            yield row, head["subroot"], node.witness() + head["witness"]


def _table(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of SPAN."""
    while out := list(islice(rows, SPAN)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def witnesses(levels: list[DataFrame], tops: DataFrame, stop: int) -> DataFrame:
    """(tree, pos, subroot, witness) of the nodes of pass ``stop``, from (tree, subroot, witness) of the trees' tops."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()),
                        ("witness", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _table(schema, ((r["tree"], r["pos"], subroot, path) for r, subroot, path in _witnessed(batches)))

    known = tops.select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "witness")
    for k in range(len(levels) - 2, stop - 1, -1):
        dealt = _with_witness(levels[k], known, F.lit(None).cast("string"))
        known = map_arrow(dealt, run, "tree string, pos long, subroot string, witness array<string>")
    return known


def check(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of
    leaves (doc_id, source, leaf, presented).

    ``presented`` is the leaf that a reader has now; null means the original.
    """
    named = leaves.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
                          F.col("leaf").alias("digest"), "presented")
    placed = cut(positions(named, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]))
    sources = passes(placed)
    subroots = sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    whole = passes(cut(positions(subroots, "tree", [F.col("source").asc()])))
    top = whole[-1].select("digest").first()
    root = top["digest"] if top else ""
    tip = whole[-1].select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("witness"))
    tops = (witnesses(whole, tip, 0).drop("tree", "subroot").join(whole[0].select("pos", "source", "digest"), "pos")
            .select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "witness"))
    above = cut(witnesses(sources, cut(tops), 1))
    out = pa.schema([("doc_id", to_arrow_type(leaves.schema["doc_id"].dataType)),
                     *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
                     ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row, subroot, path in _witnessed(batches):
                folded = fold(row["carried"]["presented"] or row["digest"], path)
                yield (row["carried"]["doc_id"], row["digest"], subroot, root, _digest("".join(path)), folded, folded == root)
        yield from _table(out, rows())

    return map_arrow(_with_witness(placed, above, F.struct("doc_id", "presented")), run,
                     f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, "
                     "proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                    source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, leaf, presented); where ``tampered`` holds, the presented row has its text's A-Z lower-cased."""
    changed = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
        leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        F.when(tampered, leaf([changed if c == text_col else F.col(f"`{c}`") for c in fields])).alias("presented"))
