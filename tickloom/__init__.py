"""tickloom: market-data tables and portfolio research as Spark DataFrame transforms.

Sub-packages

* ``sources``    table catalogue, scans, sinks, spreadsheet and JDBC access
* ``functions``  column expressions (text, nulls, dates, fees, addresses)
* ``operators``  DataFrame in, DataFrame out
* ``plans``      composed jobs: ingest, research chain, holdings replay
* ``streaming``  incremental jobs on Structured Streaming
* ``workload``   the registered queries and their SQL counterparts
"""

__version__ = "0.1.0"
