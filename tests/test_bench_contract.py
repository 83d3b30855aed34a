"""bench.py prints one JSON line with the keys the driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="kpis,segments")
    out = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    record = json.loads(lines[-1])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(record)
    assert record["unit"] == "sec" and set(record["queries"]) == {"kpis", "segments"}
    assert record["value"] >= sum(record["queries"].values())
