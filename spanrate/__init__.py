"""spanrate: event cohorts, person-time and incidence rates as Spark DataFrames."""
