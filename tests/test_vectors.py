"""The pivot index against all comparisons."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.operators import vectors
from tessera.sources.folders import cut


def crowd(draw, n, dims, clusters, spread):
    centres = draw.normal(size=(clusters, dims))
    return centres[draw.integers(0, clusters, n)] + spread * draw.normal(size=(n, dims))


@pytest.mark.parametrize("cosine, spread", [(0.97, 0.15), (0.85, 0.4), (0.5, 0.8), (0.999, 0.02)])
def test_twins_equal_all_comparisons(spark, cosine, spread):
    """A third of the rows are copies of one vector; odd ones have no direction."""
    draw = np.random.default_rng(3)
    data = [x.tolist() for x in crowd(draw, 240, 16, 12, spread)] + [[1.0] + [0.5] * 15] * 120
    odd = [None, [], [0.0] * 16, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [float("nan")] + [1.0] * 15]
    rows = [(10 * i, v) for i, v in enumerate(data + odd)]
    got = {r["vec_id"]: (r["twin"], r["near"]) for r in vectors.twins(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cut, cosine).collect()}
    for i, v in rows:
        near = [j for j, w in rows if j != i and v and w and len(v) == len(w) and np.dot(v, v) > 0 and np.dot(w, w) > 0 and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= cosine - 1e-12]
        assert got[i] == (min(near, default=None), len(near)), i


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    data = crowd(np.random.default_rng(8), 1500, 16, 40, 0.05).tolist()
    kinds = vectors.classes(spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>"), cut)
    shares = [vectors.candidates(kinds, c).count() / 1500**2 for c in (0.97, 0.99)]
    assert shares[1] <= shares[0] < 0.1, shares


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_are_compared_without_rows_of_pairs(spark):
    """Neither copies of vectors nor pairs are rows of a join: Spark takes copies for far smaller than they are, and sent them to the driver."""
    data = crowd(np.random.default_rng(8), 3000, 16, 40, 0.3).tolist()
    base = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    joined = []

    def counted(df):
        joined.append(plan(df))
        return cut(df)

    vectors.twins(base, counted, 0.9)
    queries = base.where("vec_id % 100 = 0")
    joined += [plan(vectors.probed(base, queries, [0.9])), plan(vectors.nearest(base, queries, 5))]
    assert len(joined) == 4 and not [p for p in joined if "Join" in p]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_and_counts_equal_all_comparisons(spark, kind, monkeypatch):
    """Copies, vectors at the limit and without a direction; cosines as SQL has them, not rounded before they are held against a limit."""
    monkeypatch.setattr(vectors, "WORTH", 100)
    draw = np.random.default_rng(4)
    near = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.6 - 1e-7, 0.8, 0.0], [0.6 + 1e-7, 0.8, 0.0], [0.6, 0.0, 0.8], [0.0, 0.0, 0.0], [2.0, 0.0, 0.0]]
    data = near + draw.normal(size=(600, 3)).round(1).tolist() + [[0.3, 0.4, 0.5]] * 40
    rows = [(7 * i, v) for i, v in enumerate(data)] + [(9001, None)]
    base = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    queries = base.where("vec_id % 3 = 0 OR vec_id = 35")
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    con.sql(f"""CREATE TABLE p AS WITH u AS (SELECT vec_id, embedding::{kind.upper()}[]::DOUBLE[] AS e FROM embeddings) SELECT q.vec_id AS query_id, b.vec_id,
        list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 3 = 0 OR q.vec_id = 35""")
    text = lambda data: sorted(map(str, data))
    got = vectors.probed(base, queries, [0.97, 0.6]).select("id", "least_0", "near_0", "least_1", "near_1").collect()
    want = con.sql("SELECT query_id, min(vec_id) FILTER (s >= 0.97), count(*) FILTER (s >= 0.97), min(vec_id) FILTER (s >= 0.6), count(*) FILTER (s >= 0.6) FROM p GROUP BY 1").fetchall()
    assert text(map(tuple, got)) == text(want)
    got = vectors.nearest(base, queries, 5).select("query_id", "vec_id", "similarity", "place").collect()
    want = con.sql("SELECT * FROM (SELECT query_id, vec_id, round(s, 6) + 0.0, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id) AS r FROM p) WHERE r <= 5").fetchall()
    assert text(map(tuple, got)) == text(want)
