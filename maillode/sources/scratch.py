"""Where intermediate results may be written."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

from ..errors import MaillodeError


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, has a default. On a cluster a folder of the driver's
    own would lose the rows of executors, so there it is an error to name none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise MaillodeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder(spark.sparkContext.applicationId)
    if shared.startswith("file:"):
        shared = "/" + shared.removeprefix("file:").lstrip("/")
    return os.path.join(shared, f"{label}-{uuid.uuid4().hex}")


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="maillode-")
