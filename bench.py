"""Headline timings; prints one JSON line."""

import json
import os
import time

from queries import projections as P
from starloom.operators.crossmatch import crossmatch
from starloom.operators.halo import cell_occupancy, halo_replicate, tag_cells
from starloom.operators.series import assemble_series
from starloom.plans.fold import FoldOptions, fold_rounds, fold_series
from starloom.plans.percell import fold_per_cell
from starloom.session import Workspace, build_session
from starloom.streaming.fold import StreamFold


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("starloom-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    work = Workspace(spark, "bench")
    rows = work.save(P.shipments(spark, sf_dir), "shipments")
    middle = 42
    left, right = rows.filter(f"epoch <= {middle}"), rows.filter(f"epoch > {middle}")
    first = work.save(fold_series(left).references.withColumnRenamed("object_id", "source_id"), "first")

    def stream():
        state = StreamFold(spark, f"{work.path}/state")
        for n, half in enumerate([left, right]):
            state.absorb(half, n)
        sink(state.pairs())

    runs = {
        "tag_and_replicate": lambda: sink(halo_replicate(tag_cells(rows))),
        "cell_occupancy": lambda: sink(cell_occupancy(tag_cells(rows))),
        "crossmatch_broadcast": lambda: sink(crossmatch(first, right, strategy="broadcast")),
        "crossmatch_shuffle_hash": lambda: sink(crossmatch(first, right, strategy="shuffle_hash")),
        "crossmatch_merge": lambda: sink(crossmatch(first, right, strategy="merge")),
        "crossmatch_many_to_many": lambda: sink(crossmatch(left, right, strategy="shuffle_hash")),
        "fold": lambda: sink(fold_series(rows).pairs),
        "fold_evict": lambda: sink(fold_series(rows, FoldOptions(max_misses=7, miss_clock="global")).pairs),
        "fold_rounds": lambda: sink(fold_rounds(rows).pairs),
        "fold_per_cell": lambda: sink(fold_per_cell(rows).pairs),
        "series": lambda: sink(assemble_series(fold_series(rows).pairs)),
        "stream_two_batches": stream,
    }
    times = {}
    for name, run in runs.items():
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "rows": rows.count(),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
