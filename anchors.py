"""Three operators against the plain way to do the same work, at $BENCH_SF_DIR; prints one JSON line of cold and warm seconds.

skyline: blocks of a grid, against a nested-loop anti join; parity: the relational product, against the dense product of
0/1 matrices in numpy; rules: rules over all incidence rows at once, against a loop over documents in Python."""

from __future__ import annotations

import json
import os
import time


def timed(run) -> list[float]:
    """Seconds of a first and a second run."""
    out = []
    for _ in range(2):
        began = time.time()
        run()
        out.append(round(time.time() - began, 2))
    return out


def main() -> None:
    import numpy as np
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from claimboard.functions.tables import written
    from claimboard.operators import parity, rules, skyline
    from claimboard.plans.base import entries, incidence

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    minimize, maximize = ["n", "w"], ["k", "d"]
    e = written(entries(spark, sf), "entries")

    def nested():
        a, b = e.alias("a"), e.alias("b")
        return a.join(F.broadcast(b), skyline.dominates("b", "a", minimize, maximize), "left_anti").count()

    rows = written(incidence(spark, sf), "incidence")
    x = rows.filter("side = 'X'").select(F.col("check_idx").alias("a"), "qubit")
    z = rows.filter("side = 'Z'").select(F.col("check_idx").alias("b"), "qubit")

    def dense():
        sides = [df.toPandas() for df in (x, z)]
        width = max(s["qubit"].max() for s in sides) + 1
        if any(s.iloc[:, 0].nunique() * int(width) > 500_000_000 for s in sides):
            return None  # the matrices alone would take gigabytes
        made = []
        for s in sides:
            places, at = np.unique(s.iloc[:, 0], return_inverse=True)
            m = np.zeros((len(places), width), np.float32)
            np.add.at(m, (at, s["qubit"]), 1)
            made.append(m)
        return sum(int((made[0][i : i + 4096] @ made[1].T % 2).sum()) for i in range(0, len(made[0]), 4096))

    def loop():
        documents: dict = {}
        for r in rows.toLocalIterator():
            documents.setdefault(r["key"], {}).setdefault(r["check_idx"], []).append(r["qubit"])
        return sum(all(len(m) == len(set(m)) for m in d.values()) for d in documents.values())

    out = {
        "skyline": timed(lambda: skyline.skyline(e, minimize, maximize).count()), "nested_loop": timed(nested),
        "parity_product": timed(lambda: parity.parity_product(x, z, ["qubit"], "a", "b").count()), "dense_product": timed(dense),
        "rules": timed(lambda: rules.repeated_members(rows, "key", "check_idx", "qubit").filter("ok").count()), "document_loop": timed(loop),
    }
    print(json.dumps({"sf": os.path.basename(sf), "entries": e.count(), "incidence": rows.count(), "seconds": out}))
    spark.stop()


if __name__ == "__main__":
    main()
