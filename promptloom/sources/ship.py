"""The package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def on_workers(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application, where they wouldn't find it by themselves.

    They do where its folder is in PYTHONPATH, or is the folder that the application was started in.
    """
    app = spark.sparkContext.applicationId
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _sent or str(_ROOT) in {os.path.abspath(p) for p in paths if p}:
        return
    folder = tempfile.mkdtemp(prefix="promptloom-py-")  # the driver serves it from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/promptloom-package", "zip", _ROOT, "promptloom"))
    _sent.add(app)
