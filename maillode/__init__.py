"""Mail-archive and file-corpus analytics on Spark.

``sources``    Maildir trees, the stored index, adapters for driver tables
``functions``  Column expressions: type detection, text, headers, names
``operators``  DataFrame to DataFrame steps: MIME explode, dedup, browse, reports
``plans``      whole jobs: ingest, the versioned index, views
``streaming``  the incremental forms of ingest
``catalog``    the registered queries with their reference SQL
"""

import sys

from pyspark import cloudpickle

# Python stages travel with the plan, so executors need no installed copy. A
# stage must name the functions it uses, not their module: a module would be
# sent whole, and with it what belongs to the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
