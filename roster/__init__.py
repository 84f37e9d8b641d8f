"""Class-management analytics on Spark DataFrames: model tables, reports, rosters, links and set-based change jobs."""
