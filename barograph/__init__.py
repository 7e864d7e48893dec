"""Market-data analytics on Spark DataFrames: bars, features, alerts, scoring, back-tests, serving and decision rules."""
