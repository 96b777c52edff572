"""bench.py prints one JSON line with the agreed fields (smallest scale factor, one run)."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="4", BENCH_RUNS="1")
    out = subprocess.run([sys.executable, f"{ROOT}/bench.py"], capture_output=True, text=True,
                         timeout=1200, env=env, cwd="/tmp")
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, out.stderr[-2000:]
    res = json.loads(lines[0])
    assert res["unit"] == "sec" and res["value"] > 0 and res["sf"] == 0.001
    assert set(res["queries"]) >= {"build_knowledge_base", "retrieve_threshold", "ivf_search", "triplets"}
