"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_all_registered_queries_match_duckdb():
    out = subprocess.run([sys.executable, f"{ROOT}/tests/oracle_check.py", SF_SMALL],
                         capture_output=True, text=True, timeout=1800)
    lines = [x for x in out.stdout.splitlines() if x.startswith(("OK", "FAIL", "ROWS"))]
    failed = [x for x in lines if x.startswith("FAIL")]
    assert lines and not failed, "\n".join(failed)[:3000]
