"""oeeforge: production-rate and OEE analytics as Spark DataFrame jobs.

Layout
------
- ``sources``   readers: export folders, the history table, the production view
                derived from the driver tables, question tables.
- ``functions`` small Column helpers (NULL rules, severity ranks, safe division).
- ``operators`` the domain operators: quality rules, profiling, load/dedup,
                metrics, outliers, recommendations, diagnosis, MLlib, questions.
- ``plans``     jobs that chain operators (load job, analysis job) and the
                registry of named queries used by ``__spark_entry__``.
- ``streaming`` incremental folder load with Structured Streaming.

Every operator is ``DataFrame(s), config -> DataFrame``; nothing is collected.
"""

__version__ = "0.1.0"
