import numpy as np
import pytest

from arcflow import cli
from arcflow.sources import coo, edges


def test_text_edges(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text("# comment\n7\t3\n3\t7\n# more\n9\t3\n")
    found = edges.read_edge_text(spark, str(path))
    ids = edges.dense_ids(found)
    assert [tuple(r) for r in ids.orderBy("id").collect()] == [(3, 0), (7, 1), (9, 2)]
    assert sorted(tuple(r) for r in edges.remap(found, ids).collect()) == [(0, 1), (1, 0), (2, 0)]


def test_binary_edges_there_and_back(spark, tmp_path):
    coo.register(spark)
    rows = [(2, 0), (0, 1), (1, 0), (0, 1), (3, 3)]
    path = str(tmp_path / "e.bin")
    assert coo.write_coo(spark.createDataFrame(rows, "src long, dst long"), path) == 5
    raw = np.fromfile(path, "<i4").reshape(2, -1)
    assert raw[1].tolist() == sorted(d for _, d in rows)
    for chunk in (2, 100):
        assert sorted(tuple(r) for r in spark.read.format("coo").option("chunk", chunk).load(path).collect()) == sorted(rows)
    with pytest.raises(Exception, match="bytes"):
        spark.read.format("coo").option("edges", 4).load(path).collect()
    with pytest.raises(Exception, match="outside"):
        spark.read.format("coo").option("nodes", 3).load(path).collect()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    assert sorted(tuple(r) for r in coo.read_coo(spark, "viewfs://far/in/e.bin", 5, 4).collect()) == sorted(rows)
    assert sorted(tuple(r) for r in coo.read_coo(spark, path, 5, 4).collect()) == sorted(rows)
    edges.write_edge_parquet(spark.createDataFrame(rows, "src long, dst long"), str(tmp_path / "p"))
    assert sorted(tuple(r) for r in edges.read_edge_parquet(spark, str(tmp_path / "p")).collect()) == sorted(rows)


def far(spark, tmp_path):
    """The folder behind a scheme that only Spark's readers open; Hadoop keeps a mount table by its name."""
    name = f"far{abs(hash(str(tmp_path)))}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in"


@pytest.mark.parametrize("n", [4099, 5000, 1, 0])
def test_binary_edges_in_another_store(spark, tmp_path, n):
    """Any number of edges, also a prime one over 4,096."""
    edges_in = spark.range(n).selectExpr("(id * 7919) % 1000 as src", "(id * 104729) % 997 as dst")
    want = sorted(map(tuple, edges_in.collect()))
    for path in (f"{far(spark, tmp_path)}/w.bin", str(tmp_path / "l.bin")):
        assert coo.write_coo(edges_in, path) == n
        assert sorted(map(tuple, coo.read_coo(spark, path, n, 1000).collect())) == want
    assert (tmp_path / "w.bin").read_bytes() == (tmp_path / "l.bin").read_bytes()
    if n > 1:
        with pytest.raises(Exception, match="outside"):
            coo.read_coo(spark, f"{far(spark, tmp_path)}/w.bin", n, 1).collect()
    with pytest.raises(ValueError, match="bytes"):
        coo.read_coo(spark, f"{far(spark, tmp_path)}/w.bin", n + 1)


def test_binary_edges_have_32_bits(spark, tmp_path):
    for bad in (-1, 1 << 31):
        with pytest.raises(ValueError, match="32-bit"):
            coo.write_coo(spark.createDataFrame([(0, bad)], "src long, dst long"), str(tmp_path / "e.bin"))


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "e.bin")
    coo.write_coo(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"), path)
    assert cli.main(["-f", path, "-n", "3", "-e", "3", "--mode", "sync"], spark) == 0
    assert "0.999956" in capsys.readouterr().out
    assert cli.main(["-f", path], spark) == 1


def test_command_line_options(spark, tmp_path, capsys):
    path, out = str(tmp_path / "e.bin"), str(tmp_path / "ranks")
    coo.write_coo(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"), path)
    sized = ["-f", path, "-n", "3", "-e", "3"]
    assert cli.main([*sized, "--iterations", "1", "--damping", "0.5", "--output", out], spark) == 0
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == [0.75] * 3
    assert cli.main([*sized, "--mode", "mc", "--length", "7", "--seed", "3", "--replicas", "2"], spark) == 0
    assert cli.main([*sized, "--mode", "linf", "--tolerance", "0.5", "--repeats", "2", "--strategy", "broadcast"], spark) == 0
    assert cli.main([*sized, "--mode", "async", "--tolerance", "0.1", "--target", "77"], spark) == 0
    assert "no node 77" in capsys.readouterr().out
    assert cli.main([*sized, "--mode", "mc", "--repeats", "2"], spark) == 1
    assert cli.parse(["--preset", "google"]).file == "datasets/google.bin" and cli.parse(["--preset", "google"]).edges == 5_105_039
