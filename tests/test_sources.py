"""Text forms: readers, writers, what they refuse, and round trips."""

import pytest

from quillgraph.sources import lines, memberships, metis

NINE = ["% two cliques and a bridge", "9 13", "2 3 4 5", "1 3 4", "4 2 1", "1 2 3", "1 6 7 8", "5 8 7", "% between", "5 6 8", "5 6 7", ""]
WEIGHTED = ["4 4 1", "2 0.5 3 5e-2", "1 0.5 3 1", "1 0.05 2 1 4 2", "3 2"]
BIPARTITE = ["% left, right, edges", "3 2 4", "1 2", "2", "1", "1 3", "1 2"]


def file_of(folder, content, name="x.txt"):
    path = folder / name
    path.write_text("\n".join(content) + "\n")
    return str(path)


def test_numbers_of_lines_in_many_files(spark, tmp_path):
    for i in range(5):
        file_of(tmp_path, [f"{i}-{j}" for j in range(i + 1)], f"part-{i}.txt")
    got = [r.value for r in lines.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [f"{i}-{j}" for i in range(5) for j in range(i + 1)]


def test_numbers_of_lines_in_splits(spark, tmp_path):
    path = file_of(tmp_path, [f"{i} " + "x" * (i % 50) for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = lines.numbered_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        assert all(r.value.startswith(f"{r.line} ") for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_metis(spark, tmp_path):
    g = metis.read_metis(spark, file_of(tmp_path, NINE))
    assert (g.n_vertices, g.n_edges, g.weighted, g.warnings) == (9, 13, False, ())
    near = {}
    for r in g.edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    assert near[0] == {1, 2, 3, 4} and near[4] == {0, 5, 6, 7} and 8 not in near and g.vertices.count() == 9
    metis.write_metis(g.edges, g.vertices, str(tmp_path / "out"))
    again = metis.read_metis(spark, str(tmp_path / "out"))
    assert sorted(again.edges.collect()) == sorted(g.edges.collect()) and again.n_vertices == 9
    with pytest.raises(Exception, match="(?i)exist"):
        metis.write_metis(g.edges, g.vertices, str(tmp_path / "out"))


def test_weighted_metis(spark, tmp_path):
    g = metis.read_metis(spark, file_of(tmp_path, WEIGHTED))
    w = {(r.src, r.dst): r.w for r in g.edges.collect()}
    assert g.weighted and w[0, 2] == w[2, 0] == 0.05 and w[2, 3] == 2.0 and len(w) == 8
    text = [r.value for r in metis.metis_lines(g.edges, g.vertices, "%.2f").orderBy("line").collect()]
    assert text == ["4 4 1", "2 0.50 3 0.05", "1 0.50 3 1.00", "1 0.05 2 1.00 4 2.00", "3 2.00"]


@pytest.mark.parametrize(
    ("content", "what"),
    [(["2 1", "0", "1"], "from 1"), (["3 1", "2 3", "1", ""], "both directions"), (["4 2", "2 3", "1", "", "1"], "one-sided"), (["2 1", "2 2", "1 1"], "repeated"), (["2 1 1", "2 0.5", "1 0.6"], "weights differ"), (["x"], "first line")],
)
def test_metis_refuses(spark, tmp_path, content, what):
    with pytest.raises(ValueError, match=what):
        metis.read_metis(spark, file_of(tmp_path, content))


def test_another_number_of_edges_is_only_noted(spark, tmp_path):
    assert metis.read_metis(spark, file_of(tmp_path, ["2 7", "2", "1"])).warnings == ("the header has 7 edges, the lines 1",)


def test_bipartite(spark, tmp_path):
    g = metis.read_bipartite_metis(spark, file_of(tmp_path, BIPARTITE))
    assert (g.n_left, g.n_right, g.n_edges) == (3, 2, 4)
    assert {(r.l, r.r) for r in g.edges.collect()} == {(0, 0), (0, 1), (1, 1), (2, 0)}


@pytest.mark.parametrize(
    ("change", "what"), [((-1, "1"), "one direction"), ((1, "3 2 5"), "header has 5"), ((2, "1 3"), "out of range"), ((1, "4 2 4"), "were due")]
)
def test_bipartite_refuses(spark, tmp_path, change, what):
    content = list(BIPARTITE)
    content[change[0]] = change[1]
    with pytest.raises(ValueError, match=what):
        metis.read_bipartite_metis(spark, file_of(tmp_path, content))


def test_memberships(spark, tmp_path):
    path = file_of(tmp_path, ["1 4", "", "2", "1 2 4", "1"])
    z = memberships.read_rows(spark, path, 5)
    columns = {}
    for r in z.collect():
        columns.setdefault(r.cluster, set()).add(r.vertex)
    assert columns == {0: {0, 3, 4}, 1: {2, 3}, 3: {0, 3}}
    with pytest.raises(ValueError, match="6 lines"):
        memberships.read_rows(spark, path, 6)
    assert [r.value for r in memberships.row_lines(z, spark.range(5)).orderBy("line").collect()] == ["1 4", "", "2", "1 2 4", "1"]
    out = [r.value for r in memberships.column_lines(z, spark.range(4)).orderBy("line").collect()]
    assert out == ["1 4 5", "3 4", "", "1 4"]
    back = memberships.read_columns(spark, file_of(tmp_path, out, "columns.txt"))
    assert sorted(back.collect()) == sorted(z.collect())
    sets = z.groupBy("cluster").agg({"vertex": "collect_list"}).toDF("cluster", "members")
    assert sorted(memberships.from_sets(sets).collect()) == sorted(z.collect())
    with pytest.raises(ValueError, match="line 2"):
        memberships.read_rows(spark, file_of(tmp_path, ["1", "0"], "bad.txt"))


def test_scored_and_precision_lines(spark):
    m = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.123), (2, 1, 1.0)], "row long, col long, value double")
    got = [r.value for r in memberships.scored_lines(m, spark.range(3), 2).orderBy("line").collect()]
    assert got == ["3 2", "1:0.12 2:0.50", "", "2:1.0"]
    p = spark.createDataFrame([(4, 1.0), (1, 0.256)], "cluster long, precision double")
    assert [r.value for r in memberships.precision_lines(p).orderBy("line").collect()] == ["0.26", "1.00"]
