"""Codes and whitening of vectors against plain NumPy, on nulls, ties, repeated rows, clashing columns and no rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import lloyd, queries, whitening
from tideline.llm.oracle import ORACLE_SQL

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, x string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "x", 7) for r in rows], SCHEMA)


def drawn(n, size=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, size))
    return [(int(i), (centres[i % 5] + rng.normal(0, 0.1, size)).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]


BROKEN = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, None), (903, [float("inf")] + [0.0] * 15, 2)]


def plain_codes(rows, rounds=6):
    x = np.floor(4096 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    x = x.reshape(len(rows), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p][:, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(8)], 1)
    for _ in range(rounds):
        code = nearest()
        for p in range(8):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    code = nearest()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(8))
    return code, error, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 5, 16, 300])
def test_codes_equal_plain_rounds(spark, n):
    rows = drawn(n) + [(1000 + i, r[1], None) for i, r in enumerate(drawn(min(n, 40)))]  # repeated vectors tie
    coded, books = lloyd.compress(table(spark, rows[::-1] + BROKEN))
    got = {r.vec_id: r for r in lloyd.with_label_error(coded).collect()}
    code, error, digest = plain_codes(rows)
    assert books.digest() == digest and set(got) == {r[0] for r in rows}
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    for r, c, e in zip(rows, code, error, strict=True):
        assert got[r[0]].code == c.tolist() and got[r[0]].error == e and got[r[0]].label_error == total[r[2]]


def test_codes_on_a_grid_of_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 8) / 2).tolist(), 0) for i in range(200)]
    coded, books = lloyd.compress(table(spark, rows))
    code, error, digest = plain_codes(rows)
    assert books.digest() == digest and [r.error for r in coded.orderBy("vec_id").collect()] == error.tolist()


def test_bounds_skip_most_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 20, (500, 1, 4)) for c in (-4000, 0, 5000)]).astype(np.int64)
    books = lloyd.Codebooks.first(x[[0, 500, 1000]].transpose(1, 0, 2).copy())
    code, upper, lower = (a[:, None] for a in lloyd.scan(x[:, 0], books.entries[0]))
    scans = 0
    for _ in range(4):
        new = np.stack([[x[code[:, 0] == e, 0].sum(0) // (code[:, 0] == e).sum() for e in range(3)]])
        books = books.after(new)
        scans += lloyd.reassign(x, code, upper, lower, books)
        assert (code[:, 0] == ((x - books.entries[0]) ** 2).sum(2).argmin(1)).all()
        own = np.sqrt(((x[:, 0] - books.entries[0][code[:, 0]]) ** 2).sum(1))
        assert (upper[:, 0] >= own).all()
    assert scans < 0.05 * 4 * len(x)


def test_codes_of_no_rows_and_of_wrong_lengths(spark):
    coded, _ = lloyd.compress(table(spark, BROKEN))
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"]
    for rows in ([(1, [0.5] * 7, 0)], [(1, [0.5] * 8, 0), (2, [0.5] * 16, 0)], [(1, [], 0)]):
        with pytest.raises(ValueError):
            lloyd.compress(table(spark, rows))
    with pytest.raises(Exception, match="magnitude"):
        lloyd.compress(table(spark, [(1, [1e30] * 8, 0)]))[0].collect()
    coded, _ = lloyd.compress(table(spark, [(None, [0.5] * 8, 0), (3, [-0.5] * 8, 0)]))
    assert [(r.vec_id, r.code[0]) for r in coded.orderBy("vec_id").collect()] == [(None, 1), (3, 0)]


def test_codes_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op12_vector_codes"]).df().sort_values("vec_id")
    got = queries.op12_vector_codes(spark, sf).toPandas().sort_values("vec_id")
    for c in want.columns:
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c


def test_whitening_equals_plain(spark):
    rows = drawn(400, 12, 3) + [(1000 + i, r[1], 0) for i, r in enumerate(drawn(90, 12, 3))]
    got = whitening.whiten(table(spark, rows + [(r[0], r[1] and r[1][:12], r[2]) for r in BROKEN])).toPandas()
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n = len(fit)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - fit.mean(0)) @ axes[:, :4] / np.sqrt(values[:4])
    frame = got.sort_values(["vec_id", "component"])
    white = frame.whitened.to_numpy().reshape(-1, 4)[np.argsort(np.argsort([r[0] for r in rows]))]
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-9 and set(frame.n) == {n} and sorted(set(frame.component)) == [1, 2, 3, 4]
    assert frame.identity_error.max() < 1e-9 and np.abs(frame.explained.to_numpy()[:4] - values[:4] / values.sum()).max() < 1e-12
    deviation = ((n * x - fit.sum(0)) ** 2).sum(1)
    assert dict(zip(frame.vec_id, frame.deviation, strict=True)) == dict(zip([r[0] for r in rows], deviation.tolist(), strict=True))
    assert queries.op13_whitening(spark, "/root/testdata/sf0.001").agg(F.max("identity_error")).first()[0] < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, BROKEN)).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, 1.0], 0), (None, [0.25, 1.0], 0), (1, [0.5, 1.0], 0)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.explained) for r in one] == [(None, 1, 2, 1.0), (1, 1, 2, 1.0), (1, 1, 2, 1.0)]
    assert abs(abs(one[0].whitened) - 1) < 1e-12 and one[0].deviation == 64**2
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [0.5], 0), (2, [0.5, 1.0], 0)]))


def test_deviations_beyond_64_bits_are_null():
    model = whitening.Whitening(1 << 30, (0,), np.ones((1, 1)), np.ones(1), 1.0)
    assert model.deviation(np.array([[1], [1 << 30]])) == [1 << 60, None]
    assert np.allclose(model.whitened(np.array([[1 << 34]])), [[1 << 34]])
