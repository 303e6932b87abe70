"""The side of a join that is sent to every task is the bounded one."""

import numpy as np

from tessera.operators import weighted


def sent(frame):
    """What the plan sends to every task, as text."""
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text
    return text


def cells(spark, n=200):
    rng = np.random.RandomState(3)
    rows = [(str(i), int(c), float(u)) for i in range(n) for c, u in zip(rng.permutation(16)[:6], rng.rand(6) ** 3, strict=True)]
    return spark.createDataFrame(rows, "id string, cell_id bigint, fill double"), rows


def test_parameters_are_sent_to_the_cells(spark):
    cells_, _ = cells(spark)
    assert "rightHint=(strategy=broadcast)" in sent(weighted.consistent_hashes(cells_, weighted.consistent_parameters(spark, 16)))


def test_draws_are_sent_to_the_cells(spark):
    cells_, rows = cells(spark)
    points = weighted.rejection_points(spark, 16, attempts=300)
    found = weighted.rejection_hashes(cells_, points)
    assert "rightHint=(strategy=broadcast)" in sent(found)
    want = {}
    for p in sorted(map(tuple, points.collect()), key=lambda p: p[1]):
        for i, c, fill in rows:
            if p[2] == c and p[3] < fill:
                want.setdefault((i, p[0]), p[1])
    assert {(r["id"], r["table_id"]): r["hash"] for r in found.collect()} == want
