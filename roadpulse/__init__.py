"""roadpulse: set-oriented incident-impact analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver.  Sub-packages:

* ``functions``  - Column expressions (calendar, geometry, scoring rules)
* ``sources``    - readers / writers and the test-table fixtures
* ``operators``  - cleaning, spatial joins, dashboards, scoring, ML, metrics
* ``plans``      - end-to-end compositions and the query catalog
* ``streaming``  - Structured Streaming jobs
"""

__all__ = ["session"]
