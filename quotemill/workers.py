"""Python workers find this package even where it is only on the driver's own path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkContext

ROOT = str(Path(__file__).resolve().parent.parent)


def importable() -> None:
    """Adds the package's place to the workers' PYTHONPATH. On a cluster, ship the package
    with ``--py-files`` or install it; this path is then of no effect."""
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
