from pathlib import Path

import pytest

from pathloom.operators.fixpoint import Strategy
from pathloom.query import PathQuery
from pathloom.sources.graphs import Graph
from pathloom.streaming.incremental import ReachView

SCHEMA = "src long, label string, dst long, p long"
BATCHES = [[(0, "a", 1, None)], [(1, "b", 2, None), (7, "a", 8, 1)], [(8, "b", 9, 1), (8, "b", 9, 1), (0, "a", 1, None)], [(2, "a", 3, None), (3, "b", 4, None), (None, "a", 1, 1)]]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("part", ["p", None])
def test_view_follows_inserted_edges_across_restarts(spark, tmp_path, part):
    """Every batch meets a view of its own on the same folder and checkpoint, as after a crash."""
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for k, own in enumerate(BATCHES):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        view = ReachView(spark, "S -> S S | a S b | a b", str(tmp_path / "state"), part=part)
        assert view.last == k - 1
        view.start(stream(), str(tmp_path / "checkpoint")).awaitTermination(120)
        every = spark.createDataFrame([e for b in BATCHES[: k + 1] for e in b], SCHEMA)
        expected = PathQuery(Graph.from_frame(every), "S -> S S | a S b | a b", strategy=Strategy(local_edges=0)).reach()
        assert rows(view.pairs) == rows(expected) and view.edges.count() == every.dropna(subset=["src"]).distinct().count()
    assert rows(view.pairs) == [(0, 2), (0, 4), (2, 4), (7, 9)]
    # an applied batch changes nothing; one whose mark is missing is written anew
    again = ReachView(spark, "S -> S S | a S b | a b", str(tmp_path / "state"), part=part)
    again.apply(spark.createDataFrame([(5, "a", 6, 2), (6, "b", 7, 2)], SCHEMA), again.last)
    assert rows(again.pairs) == rows(view.pairs)
    (tmp_path / f"state/marks/{again.last}").unlink()
    for crc in (tmp_path / "state/marks").glob(f".{again.last}.crc"):
        crc.unlink()
    undone = ReachView(spark, "S -> S S | a S b | a b", str(tmp_path / "state"), part=part)
    assert undone.last == again.last - 1 and rows(undone.pairs) == [(0, 2), (7, 9)]
    undone.apply(spark.createDataFrame(BATCHES[3], SCHEMA), undone.last + 1)
    assert rows(undone.pairs) == rows(view.pairs)


def test_view_without_labels_or_with_empty_walks(spark, tmp_path):
    edges = spark.createDataFrame([(0, "a", 1, 0)], SCHEMA)
    view = ReachView(spark, "S -> z", str(tmp_path / "none"))
    view.apply(edges, 0)
    assert rows(view.pairs) == []
    view = ReachView(spark, "S -> a S |", str(tmp_path / "empty"))
    view.apply(edges, 0)
    view.apply(edges.limit(0), 1)
    view.apply(spark.createDataFrame([(1, "a", 2, 0)], SCHEMA), 2)
    assert rows(view.pairs) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def test_folders_stay_few(spark, tmp_path):
    """Fifty batches' rows lie in a few folders, none twice; frames read before a batch outlive it; rounds leave no tables behind."""
    view = ReachView(spark, "S -> a S | a", str(tmp_path / "state"))
    most = 0
    for n in range(50):
        before = view.pairs
        view._add(spark.createDataFrame([(n, n)], "src long, dst long").coalesce(1), "pairs", n)
        view.last = n
        view._merge("pairs")
        most = max(most, len([p for p in (tmp_path / "state/pairs").iterdir()]))
        if n % 7 == 6:
            assert before.count() == n and view.pairs.count() == n + 1
    assert most <= 2 * (view.MOST + 1) and rows(view.pairs) == [(n, n) for n in range(50)]
    again = ReachView(spark, "S -> a S | a", str(tmp_path / "other"))
    again.apply(spark.createDataFrame([(0, "a", 1, 0)], SCHEMA), 0)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert rows(again.pairs) == [(0, 1)] and not list(Path(shared).glob("view-*/*"))
