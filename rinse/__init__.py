"""rinse: service-sales analytics (reports, commissions, promotions, prize draws,
table upkeep, data quality, running-state streams) as plain Spark DataFrame jobs.

Every operator is a function DataFrame(s) -> DataFrame built from
``pyspark.sql.functions``, joins, aggregates and windows, so Catalyst and
AQE choose the physical plan.  Nothing is collected to the driver except
scalar parameters resolved before the job starts.
"""

__version__ = "0.1.0"
