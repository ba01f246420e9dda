"""Queries over all pairs of consecutive complete snapshots."""

from stratagraph.queries import relations


def test_later_snapshots_count_and_missing_ones_are_skipped(spark, tmp_path):
    rows = []
    for project, snapshots in {"p": {1: "ab", 2: "ab", 3: "ac", 5: "c"}, "q": {2: "xy", 3: "x"}, "r": {1: "m", 4: "n"}}.items():
        rows += [(project, no, i, i, "function", (f"{project}.py",), ([("int",)], "int" if no < 5 else "str"), (True,)) for no, ids in snapshots.items() for i in ids]
    spark.createDataFrame(rows, "project_id string, snapshot_no int, id string, name string, type string, source struct<file:string>, signature struct<parameters:array<struct<type:string>>,return_type:string>, metadata struct<is_exported:boolean>").write.parquet(f"{tmp_path}/cas_node.parquet")
    entries = [("p", 1, 2), ("p", 2, 2), ("p", 3, 2), ("p", 5, 1), ("q", 2, 2), ("q", 3, 1), ("r", 1, 1), ("r", 4, 9)]
    spark.createDataFrame(entries, "project_id string, snapshot_no int, node_count int").write.parquet(f"{tmp_path}/analysis_entry.parquet")
    run = lambda name, columns: {tuple(r) for r in relations.QUERIES[name](spark, str(tmp_path)).select(*columns.split()).collect()}
    assert run("snapshot_added_removed", "project_id before snapshot_no change n") == {("p", 2, 3, "deleted", 1), ("p", 2, 3, "added", 1), ("p", 3, 5, "deleted", 1), ("q", 2, 3, "deleted", 1)}
    assert run("rename_match", "project_id before snapshot_no old_id new_id") == {("p", 2, 3, "b", "c")}
    assert run("breaking_changes", "project_id before snapshot_no id kind") == {("p", 2, 3, "b", "removed"), ("p", 3, 5, "a", "removed"), ("p", 3, 5, "c", "type-change"), ("q", 2, 3, "y", "removed")}
