"""roadlens: vehicle-trajectory and traffic analytics as Spark DataFrame plans.

Layout
------
sources/    readers for drive, traffic-profile, log and document formats, plus the
            adapters that shape the driver tables into those forms
functions/  Column builders (pure expressions, JVM side)
plans/      scale helpers: distributed ordering, blocked windows, size-checked
            broadcast, salted aggregation
operators/  DataFrame -> DataFrame operators (windows, joins, metrics, traffic,
            retrieval, answer scoring, sinks)
streaming/  Structured Streaming forms of the continuous questions
registry/   named queries with their DuckDB oracle SQL
"""

__version__ = "0.1.0"
