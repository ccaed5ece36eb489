"""corpuslake: build, search and analyse large document corpora with PySpark.

The package is a library of DataFrame-in, DataFrame-out operators:

* ``corpuslake.functions``  column expressions (text, paths, vectors)
* ``corpuslake.sources``    corpus scans, chunk tables, logs, exports
* ``corpuslake.operators``  pages, chunking, retrieval, ranking, citations, ...
* ``corpuslake.plans``      multi-operator jobs (search, refresh, page import)
* ``corpuslake.streaming``  Structured Streaming jobs
"""

__version__ = "0.1.0"
