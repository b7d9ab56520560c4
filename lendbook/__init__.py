"""Credit-portfolio analytics on Spark DataFrames.

``sources``   readers, writers, the driver-table adapter and the star schema
``functions`` Column expressions: rates, ratios, bands, scorecard
``operators`` reusable DataFrame operators: prefix sums, quantiles, rules, statistics, models
``plans``     the portfolio questions built from those operators
``streaming`` scoring of applicants that arrive as a stream
"""
