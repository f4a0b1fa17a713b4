"""Matrices travel once for each strip that they meet; near ties and passes over few threads."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sigloom import registry
from sigloom.operators import merging, similarity
from sigloom.plans import merge_queries
from tests.test_blocks import clustered, table


def test_matrices_travel_by_strips(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "STRIPS", 3)
    x = clustered(400, 5, 3.0)
    blocks = similarity._blocks(table(spark, x), "id", "v")
    n, pairs = blocks.count(), similarity.block_pairs(blocks, blocks, -2.0).checkpoint()
    assert pairs.count() == n * n
    cells = similarity._cells(pairs, blocks, blocks).collect()
    assert len(cells) == 2 * 3 * n  # a matrix to each pair of blocks would be n * n of either side
    assert sum(len(r.meets) for r in cells if r.side) == n * n


def test_a_task_takes_one_cell(spark, monkeypatch):
    """A task holds the matrices of two strips, however many there are."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    blocks = similarity._blocks(table(spark, clustered(400, 5, 3.0)), "id", "v")
    pairs = similarity.block_pairs(blocks, blocks, -2.0).checkpoint()
    tasks = similarity._cells(pairs, blocks, blocks).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("cell").alias("cells")).collect()
    assert len(tasks) == similarity.STRIPS**2 and {r.cells for r in tasks} == {1}


def test_nearest_take_the_least_id_of_equals():
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=(600, 5)), rng.normal(size=(90, 5))
    two[40:] = two[:50]
    best, other = similarity._nearest((np.arange(1000, 1600), one), (np.arange(90), two), 2, False, 9)
    s = np.round(one @ two.T, 9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :2]
    assert (other == order).all() and np.allclose(best, np.take_along_axis(s, order, axis=1))
    few, _ = similarity._nearest((np.arange(3), one[:3]), (np.arange(1), two[:1]), 2, False, None)
    assert np.isinf(few[:, 1]).all() and np.isinf(few[0]).all()


def test_nearly_equal_neighbours_are_equal(spark, tmp_path):
    """Of neighbours that agree to nine digits the latest is named, whichever product is larger by a last bit."""
    vectors = [(20, (1.0, 0.0)), (21, (0.95, (1 - 0.95**2) ** 0.5)), (22, (0.95 - 1e-11, (1 - (0.95 - 1e-11) ** 2) ** 0.5)), (23, (0.0, 1.0))]
    spark.createDataFrame([(i, list(v), 0) for i, v in vectors], "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = registry.QUERIES["vector_duplicates"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(20, 22, 0.95)] == duck.execute(registry.SQL["vector_duplicates"]).fetchall()


def test_a_pass_compares_recent_threads_only(spark, monkeypatch):
    """Pairs judged before are looked for among the threads of the window, not among all."""
    seen = []
    whole = similarity.similar
    monkeypatch.setattr(merging, "similar", lambda rows, *rest: seen.append(rows.count()) or whole(rows, *rest))
    monkeypatch.setattr(merging, "WINDOW_HOURS", 1)
    monkeypatch.setattr(merging.recent_threads, "__defaults__", (1,))
    merge_queries._pass(spark, os.path.join("/root/testdata", "sf0.001"))
    assert seen[0] <= 61  # an article a minute
