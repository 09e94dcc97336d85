import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import encoders
from helixframe.sources import arrays
from tests.conftest import rows


def test_members_are_read_row_by_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 7)
    rng = np.random.default_rng(1)
    held = {"m": rng.normal(size=(5, 3)).astype(np.float32), "cols": np.asfortranarray(rng.normal(size=(4, 6))), "v": np.arange(9, dtype=np.int16), "s": np.float64(2.5), "cube": rng.normal(size=(2, 3, 2)), "flags": np.array([True, False]), "none": np.zeros((0, 4)), "empty": np.zeros((2, 0))}
    np.savez(tmp_path / "a.npz", **held)
    np.savez_compressed(tmp_path / "b.npz", m=held["m"] + 1)
    (tmp_path / "notes.txt").write_text("no archive")
    got = {}
    for r in arrays.read_npz(spark, str(tmp_path)).collect():
        got.setdefault((r.path.rsplit("/", 1)[-1], r.member), {})[r.row] = r["values"]
    for name, x in held.items():
        want = np.asarray(x, dtype=float).reshape(len(x) if np.ndim(x) else 1, -1) if np.size(x) else None
        if want is not None:
            assert [got["a.npz", name][i] for i in range(len(want))] == want.tolist(), name
    assert got["a.npz", "empty"] == {0: [], 1: []} and ("a.npz", "none") not in got
    assert got["b.npz", "m"][0] == pytest.approx((held["m"] + 1)[0].tolist())
    assert rows(arrays.npz_members(spark, str(tmp_path)).where("member = 'cube'"), "shape", "type") == [([2, 3, 2], "<f8")]


def test_objects_are_refused(spark, tmp_path):
    np.savez(tmp_path / "o.npz", o=np.array(["text"]))
    with pytest.raises(Exception, match="not numbers"):
        arrays.read_npz(spark, str(tmp_path)).collect()


def test_written_archives_are_numpys(spark, tmp_path):
    df = spark.createDataFrame([(f, m, r, [r + 0.5, float(i), -1.0]) for i, f in enumerate(["x", "y"]) for m in ("a", "b") for r in range(40)], "file string, member string, row int, values array<double>")
    bias = spark.createDataFrame([("x", "c", r, [float(r)]) for r in range(5)], df.schema)
    done = arrays.write_npz(df.union(bias).repartition(5), str(tmp_path / "out"))
    assert rows(done, "file", "rows") == [("x", 85), ("y", 80)]
    with np.load(tmp_path / "out/x.npz") as z:
        assert sorted(z.files) == ["a", "b", "c"] and z["a"].shape == (40, 3) and z["c"].shape == (5,) and z["a"][7].tolist() == [7.5, 0.0, -1.0]
    back = arrays.read_npz(spark, str(tmp_path / "out")).where("member <> 'c'").select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("file"), "member", F.col("row").cast("int").alias("row"), "values")
    assert rows(back) == rows(df)
    with pytest.raises(ValueError):
        arrays.write_npz(bias.where("row > 0"), str(tmp_path / "bad"))


def test_weights_of_a_file_encode(spark, tmp_path):
    rng = np.random.default_rng(2)
    w, b, x = rng.normal(size=(6, 4)), rng.normal(size=6), rng.normal(size=(30, 4))
    np.savez(tmp_path / "m.npz", w_enc=w, b_enc=b, other=w)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row int, x array<double>")
    got = {(r.row, r.feature): r.act for r in encoders.encode(df, arrays.weights(spark, str(tmp_path / "m.npz")), 2).collect()}
    act = np.maximum(x @ w.T + b, 0)
    want = {(i, int(f)): act[i, f] for i in range(30) for f in np.argsort(-act[i], kind="stable")[:2] if act[i, f] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
