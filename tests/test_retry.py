"""Task failures are retried and give the same results (deterministic stages)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_results_survive_retried_tasks(sf_small):
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tests", "retry_job.py"), ROOT, sf_small],
                         capture_output=True, text=True, timeout=600, cwd="/tmp")
    last = [line for line in out.stdout.splitlines() if line.startswith("{")]
    assert last, out.stderr[-2000:]
    assert json.loads(last[-1]) == {"knn": True, "qa": True}
