"""How the package reaches the Python workers of executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make ``corpuslake`` importable in Python workers, wherever the job was started.

    Nothing is done where ``PYTHONPATH`` (inherited by workers) or an earlier call has it. In local
    mode workers get the path of this copy; on a cluster the package is zipped and
    added to the job, as ``spark-submit --py-files`` would.
    """
    sc = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_corpuslake_shipped", False):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        given = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, given) if x)
    else:
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corpuslake-")), "corpuslake.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(ROOT, "corpuslake")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, ROOT))
        sc.addPyFile(archive)
    sc._corpuslake_shipped = True
