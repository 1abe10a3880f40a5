"""Times the headline queries once each, after a warm-up, and prints one line of JSON."""

import importlib
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
SKIP = set(os.environ.get("BENCH_SKIP", "").split(","))


def main() -> None:
    from pyspark.sql import SparkSession

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"{shared}/checkpoint").config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    run = lambda f: f(spark, folder).write.format("noop").mode("overwrite").save()
    run(queries["kv_scan_all"])
    seconds = {}
    for name, f in queries.items():
        if name in SKIP:
            continue
        began = time.perf_counter()
        run(f)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
