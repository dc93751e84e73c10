from quillstack.operators import tree


def test_paths_reach_every_level_and_cycles_end(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "x") for i in range(100)]
    rows += [("c1", "c2", "x"), ("c2", "c1", "x")]
    found = {r.id: (r.depth, r.path) for r in tree.with_paths(spark.createDataFrame(rows, "id string, parent_id string, name string").coalesce(1)).collect()}
    assert found == {f"n{i}": (i, ".".join(f"n{k}" for k in range(i + 1))) for i in range(100)}


def test_a_root_that_reaches_a_cycle_by_a_repeated_id(spark):
    rows = [("a", None, "x"), ("b", "a", "x"), ("a", "b", "x"), ("c", "b", "x")]
    found = sorted((r.id, r.path, r.depth) for r in tree.with_paths(spark.createDataFrame(rows, "id string, parent_id string, name string")).collect())
    assert found == [("a", "a", 0), ("b", "a.b", 1), ("c", "a.b.c", 2)]
    assert tree.with_paths(spark.createDataFrame([], "id string, parent_id string")).count() == 0
