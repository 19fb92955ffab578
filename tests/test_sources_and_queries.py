"""Files, encodings, streaming, and every query against its SQL."""

import os

import duckdb
import pytest
from hyperplane.functions import kernels as K
from hyperplane.operators import formats, gram
from hyperplane.operators.estimator import train_problems
from hyperplane.plans import catalogue
from hyperplane.sources import libsvm, sinks
from hyperplane.sources.catalog import Catalog
from hyperplane.streaming.score import score_stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_libsvm(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf+1 1:0.5 3:2 \r\n-1\n\n# note\n2\t2:1  4:-3 \n1 5:1 5:2\n")
    df, dim = libsvm.read_libsvm(spark, f"{tmp_path}/a.txt", 4)
    rows = [(r.label, r.features) for r in df.orderBy("id").collect()]
    assert dim == 5 and rows == [(1.0, {1: 0.5, 3: 2.0}), (-1.0, {}), (2.0, {2: 1.0, 4: -3.0}), (1.0, {5: 2.0})]
    assert libsvm.densified(df, 5).orderBy("id").first().x == [0.5, 0, 2.0, 0, 0]
    assert [tuple(r)[:2] for r in libsvm.classes(df).collect()] == [(1.0, 2), (-1.0, 1), (2.0, 1)]
    libsvm.write_libsvm(df, f"{tmp_path}/out")
    again, _ = libsvm.read_libsvm(spark, f"{tmp_path}/out", 4)
    assert [(r.label, r.features) for r in again.orderBy("id").collect()] == rows


@pytest.mark.parametrize("line", ["1 0:1", "1 3:1 2:1", "x 1:1", "1 a:1"])
def test_libsvm_rejects(spark, tmp_path, line):
    (tmp_path / "bad.txt").write_text(line + "\n")
    with pytest.raises(Exception):
        libsvm.read_libsvm(spark, f"{tmp_path}/bad.txt")[0].collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], -1)], "id long, x array<double>, y int").withColumn("problem", F.lit(0).cast("long"))
    model = train_problems(df, K.LINEAR, 10.0)
    sinks.write_model_text(model, f"{tmp_path}/m", 10.0, [0.5])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/m", wholetext=False).collect()]
    assert "C=10.0" in lines and "#" in lines and lines[-2:] == ["0.5", "0.5"]
    sinks.write_predictions(spark.createDataFrame([(2, 1.0), (1, -1.0)], "id long, pred double"), f"{tmp_path}/p")
    assert [r.value for r in spark.read.text(f"{tmp_path}/p").collect()] == ["-1", "1"]
    assert sinks.model_path("/a/", "d", "rbf", "smo") == "/a/d_rbf_smo.model"
    c = Catalog("/data/")
    assert c.add("w", "w.train", "w.test", 300).train == "/data/w.train" and c["w"].dim == 300 and len(list(c)) == 1


def parity(spark):
    rows = [(i, j, float(i)) for i in range(5) for j in range(1, 11) if (i + j + 1) % 2 == 0]
    return spark.createDataFrame(rows, "id long, idx int, val double")


def test_csc(spark):
    long = parity(spark)
    entries = [(r.id, r.val) for r in formats.csc_entries(long, 11).orderBy("pos").collect()]
    assert entries == [(i, float(i)) for i in (0, 2, 4, 1, 3)] * 5
    offsets = [r.start for r in formats.csc_offsets(long, 11).orderBy("idx").collect()]
    assert offsets == [0, 3, 5, 8, 10, 13, 15, 18, 20, 23, 25]
    starts = [r.start for r in formats.csr_offsets(long, spark.range(6)).orderBy("id").collect()]
    assert starts == [0, 5, 10, 15, 20, 25]


@pytest.mark.parametrize("unit, want", [(8, [0, 16, 40, 64]), (64, [0, 128, 320, 512])])
def test_slices(spark, unit, want):
    widths = [3, 6, 5, 4]
    rows = [(i, (2 * j + i) % 15 + 1, i + 1.0) for i in range(13) for j in range(1, widths[i // 4] + 1)]
    long = spark.createDataFrame(rows, "id long, idx int, val double")
    lengths = formats.row_lengths(long, spark.range(13))
    got = formats.slice_starts(lengths, 4, 2, 1, unit).orderBy("slice").collect()
    assert [r.start for r in got] == want and [r.width for r in got] == [2, 3, 3, 2]
    placed = formats.sliced(long, lengths, 4, 2, 1, unit).collect()
    assert len({r.pos for r in placed}) == len(rows)
    assert len({r.pos for r in formats.ertilp(long, 13, 2).collect()}) == len(rows) == len({r.pos for r in formats.ellpack(long, 13).collect()})


def test_stream(spark, tmp_path):
    data = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id long, x array<double>")
    data.write.parquet(f"{tmp_path}/in")
    support = spark.createDataFrame([(1, [1.0, 0.0], 1, 0.5), (2, [0.0, 1.0], -1, 0.5)], "id long, x array<double>, y int, alpha double")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    q = score_stream(stream, support, K.LINEAR).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("select id, score, pred from scored").collect()) == sorted(gram.scores(data, support, K.LINEAR).collect())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, oracle, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), oracle.sql(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "score", "pred"] and set(e.oracle_sql()) <= set(e.queries())
