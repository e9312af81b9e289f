"""The number of neighbours is chosen with one query for all rows of equal features and label."""

from __future__ import annotations

import random

import pytest

from strandlab.operators import neighbors
from strandlab.session import cut

SCHEMA = "id long, bal double, nation string, label string"


def rows(n=300, seed=3):
    r = random.Random(seed)
    return [(i, r.choice([None, 0.0, -0.0, float("nan"), *(float(v) for v in range(8))]), r.choice([None, "a", "b", "c"]), r.choice([None, "p", "q", "r"])) for i in range(n)]


def chosen(df, size=2048):
    return [tuple(r) for r in neighbors.knn_choose_k(df, 4, ["bal"], ["nation"], rows=size).orderBy("k").collect()]


@pytest.mark.parametrize("kind", ["single", "repeated"])
@pytest.mark.parametrize("size", [2048, 16])
def test_errors_are_those_of_a_query_for_each_row(spark, kind, size):
    data = rows()
    if kind == "repeated":  # ids and whole rows that come again, and rows without an id
        data = data + data[:20] + [(5, 3.0, "c", "q"), (None, 1.0, "a", "p"), (None, 7.0, None, "q")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    near = neighbors.knn_topk(df, df, 4, ["bal"], ["nation"], leave_self_out=True, rows=size)
    want = neighbors._errors_per_k(cut(near), df, 4, "id", "label", []).orderBy("k").collect()
    got = chosen(df, size)
    assert [(k, n) for k, n, _, _ in got] == [(r["k"], r["n"]) for r in want]
    assert all(abs(g[2] - r["error"]) < 1e-12 for g, r in zip(got, want, strict=True))
    assert [g[3] for g in got] == [r["k"] == min(want, key=lambda x: (round(x["error"], 9), x["k"]))["k"] for r in want]


def test_equal_rows_are_one_query_and_ties_one_candidate(spark, monkeypatch):
    seen, nearest = [], neighbors.nearest

    def counted(queries, *rest, **named):
        out = nearest(queries, *rest, **named)
        seen.append((queries.count(), out[0].groupBy("query", "distance", "label").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(neighbors, "nearest", counted)
    # queries without a nation are equally far from all near balances, whatever the nation
    data = [(i, float(i % 5), "abcd"[i % 4] if i % 10 else None, "pq"[i % 2]) for i in range(2_000)]
    assert len(chosen(spark.createDataFrame(data, SCHEMA))) == 4
    assert seen == [(len({r[1:] for r in data}), 1)]


def test_no_rows_give_no_errors(spark):
    assert chosen(spark.createDataFrame([], SCHEMA)) == []
    assert chosen(spark.createDataFrame([(1, 1.0, "a", "p")], SCHEMA)) == []
