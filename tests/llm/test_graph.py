"""Connected components: right classes, and few enough tasks for the driver to keep a record of."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feira.llm import near_dup
from feira.llm._graph import components


def expected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            one, two = find(a), find(b)
            root[max(one, two)] = min(one, two)
    return {(x, find(x)) for x in root}


def random_edges():
    draw = random.Random(5)
    return [(draw.randrange(-200, 200), draw.randrange(-200, 200)) for _ in range(170)]


@pytest.mark.parametrize("edges", [
    [],
    [(None, 1), (2, None), (3, 3)],
    [(1, 2), (2, 1), (1, 2)],
    [(k, k + 1) for k in range(40)],
    [(9, k) for k in range(9)],
    [(-5, 8), (8, 3), (3, -5), (7, 6)],
    random_edges(),
], ids=["empty", "nulls and loops", "repeated", "chain", "star around the largest", "ring", "random"])
def test_components_are_those_of_a_union_find(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == expected(edges) and len(got) == len(expected(edges))


def test_components_of_stars_take_few_tasks(spark):
    """The driver keeps a record of every task: a round over many partitions filled its memory."""
    sc, n = spark.sparkContext, 23
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("stars", "components of stars")
    try:
        edges = spark.range(0, 5000, 1, n).selectExpr("id AS a", "id DIV 50 * 50 + 49 AS b")
        got = components(edges)
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("stars") for s in sc.statusTracker().getJobInfo(j).stageIds}
        infos = [sc.statusTracker().getStageInfo(s) for s in stages]
        tasks = sum(i.numCompletedTasks for i in infos if i)
        assert {r.component for r in got.collect()} == set(range(0, 5000, 50))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert 0 < tasks < 17 * n


def test_a_block_yields_the_components_that_it_links(spark):
    """Not the texts: what is left to unite has one node for each component."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words[:60], f"x{k}", *words[61:]])) for k in range(4)]
    texts = spark.createDataFrame([*rows, (9, "something else of quite other words only")], "node long, t string")
    idf = spark.sparkContext.broadcast(near_dup.idf_table(near_dup.document_frequencies(texts, "t")))
    drawn = near_dup._signatures(texts, idf)
    members = (drawn.select("node", "samples", F.explode("keys").alias("bucket")).join(texts, "node")
               .withColumn("comp", F.expr("CASE WHEN node < 2 THEN -100 ELSE -node END")))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    got = {frozenset(r) for r in near_dup._similar_in_blocks(members.join(sizes, "bucket"), idf).collect()}
    assert got and got <= {frozenset(p) for p in ((-100, -2), (-100, -3), (-2, -3))}
    united = {(r.node, r.component) for r in components(spark.createDataFrame([tuple(p) for p in got], "a long, b long")).collect()}
    assert united == {(-100, -100), (-2, -100), (-3, -100)}


def test_near_copies_are_one_class(spark):
    words = [f"w{k}" for k in range(120)]
    near = [" ".join([*words[:60], f"x{k}", *words[61:]]) for k in range(6)]
    texts = spark.createDataFrame(list(enumerate([*near, "something else of other words only"])), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(texts).collect()}
    assert got == {**{k: 0 for k in range(6)}, 6: 6}
