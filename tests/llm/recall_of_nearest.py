"""Recall at 20 of op4_nearest against brute force: ``python tests/llm/recall_of_nearest.py FOLDER``, a folder with embeddings.parquet."""

import json
import os
import sys
import time

import numpy as np
import pyarrow.parquet as pq

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

K = 20


def exact(ids: np.ndarray, x: np.ndarray) -> dict[int, set[int]]:
    """The ids of the K nearest of each id divisible by 20, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    best = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best[int(ids[q])] = {*ids[np.argsort(-s, kind="stable")[:K]].tolist()}
    return best


def main(folder: str) -> None:
    from tessera.llm.queries import op4_nearest
    from tessera.session import cleanup, local_session

    rows = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding"])
    size = {len(v) for v in rows.column("embedding").to_pylist() if v}
    if len(size) != 1 or rows.column("embedding").null_count or rows.column("vec_id").null_count:
        raise SystemExit("this measure is for vectors of one length without nulls")
    ids = rows.column("vec_id").to_numpy()
    x = rows.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), size.pop())
    wanted = exact(ids, x)
    spark = local_session(8)
    began = time.perf_counter()
    found: dict[int, set[int]] = {}
    for r in op4_nearest(spark, folder).select("query_id", "vec_id").toArrow().to_pylist():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    seconds = time.perf_counter() - began
    recall = [len(found.get(q, set()) & best) / len(best) for q, best in wanted.items() if best]
    print(json.dumps({"vectors": len(ids), "queries": len(recall), "recall_at_20": round(float(np.mean(recall)), 4), "least": round(min(recall), 2), "seconds": round(seconds, 1)}))
    cleanup(spark)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
