"""Fleet position analytics: vehicle feeds, schedules and map tables as Spark DataFrames."""
