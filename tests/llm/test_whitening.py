import math

import numpy as np
import pytest

from strata.llm import whitening as w


def check(a, most=None):
    """Components against the definition and against an eigenvalue routine that the operator doesn't use."""
    values, vectors = w.components(a, most)
    true = np.linalg.eigvalsh(a)[::-1][:most]
    scale = max(np.linalg.norm(a), 1e-300)
    assert len(values) == len(true)
    assert np.abs(values - true).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


@pytest.mark.parametrize("spectrum", ["random", "geometric", "equal", "two", "cluster", "zero", "singular", "close"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components(spectrum, n):
    rng = np.random.default_rng(n)
    values = {
        "random": rng.standard_normal(n), "geometric": 10.0 ** -np.arange(n) if n < 20 else 0.8 ** np.arange(n), "equal": np.full(n, 3.0), "two": np.where(np.arange(n) % 2, 5.0, 1.0),
        "cluster": np.repeat([9.0, 4.0, 1.0], -(-n // 3))[:n], "zero": np.zeros(n), "singular": np.where(np.arange(n) < 2, 7.0 - np.arange(n), 0.0), "close": 1 + 1e-9 * rng.standard_normal(n),
    }[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    check(q @ np.diag(values) @ q.T)
    check(q @ np.diag(values) @ q.T, 4)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    u = w.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > 0


def plain(rows):
    """The rows that remain, n, exact deviations, eigenvalues and eigenvectors."""
    kept = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def compare(got, rows):
    kept, n, sums, values, vectors = plain(rows)
    m = min(w.COMPONENTS, len(sums))
    assert len(got) == m * len(kept)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, m + 1))
    want = {}
    for k, x in kept:
        want.setdefault(k, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x))
    for c, part in by.items():
        sign = None
        assert sorted((str(r.vec_id), r.deviation) for r in part) == sorted((str(k), d) for k, v in want.items() for d, _ in v)
        for r in part:
            assert r.n == n
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9
            if len(want[r.vec_id]) == 1:
                z = (np.array(want[r.vec_id][0][1]) - np.array(sums) / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
                sign = sign or math.copysign(1, z * r.whitened)
                assert r.whitened * sign == pytest.approx(z, abs=1e-8)


SCHEMA = "vec_id long, embedding array<float>, label int, x int, i string, row int, task int"


def run(spark, rows, folder):
    spark.createDataFrame([(k, v, 0, 0, "", 0, 0) for k, v in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return w.op11_embedding_whitening(spark, str(folder)).collect()


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(k, v) for k, v in enumerate((rng.standard_normal((300, 6)) * [5, 3, 2, 1, 0.5, 0.1]).astype(np.float32).tolist())]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(None, rows[1][1]), (2, rows[5][1])]
    rows += [(2000, None), (2001, [nan] * 6), (2002, [1.0, 2.0, None, 3.0, 4.0, 5.0]), (2003, [0.0, -inf, 0.0, 0.0, 0.0, 0.0]), (2004, [-0.0] * 6)]
    compare(run(spark, rows, tmp_path), rows)


def test_edges(spark, tmp_path):
    assert run(spark, [], tmp_path / "empty") == []
    assert run(spark, [(1, None)], tmp_path / "null") == []
    assert run(spark, [(1, [])], tmp_path / "flat") == []
    one = run(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])], tmp_path / "one")
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, None)] * 4
    line = run(spark, [(k, [float(k), 2.0 * k]) for k in range(10)], tmp_path / "line")
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    short = run(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 0.0])], tmp_path / "short")
    assert {r.vec_id: r.deviation for r in short if r.component == 1} == {1: (768 - 1024) ** 2 + 512**2, 2: 256**2 + (1536 - 512) ** 2, 3: (1536 - 1024) ** 2 + 512**2}
    huge = run(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])], tmp_path / "huge")
    assert {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 1 + 512**2}


def test_one_component_a_row_whatever_the_tasks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = [{r.vec_id: r.whitened for r in w.whiten(rows.repartition(k), "vec_id", "embedding", 4)[0].collect()} for k in (1, 7)]
    assert max(abs(a - b) for k in out[0] for a, b in zip(out[0][k], out[1][k], strict=True)) < 1e-9


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    compare(w.op11_embedding_whitening(spark, d).collect(), rows)
