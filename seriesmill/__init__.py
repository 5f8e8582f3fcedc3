"""Financial time-series analytics on Spark DataFrames.

Two families of operators, with different scaling rules:

* *series* operators work along one series.  Their input has at most one row
  per (series key, date), so a series can never be longer than the calendar
  (a century of trading days is about 25,000 rows) whatever the data volume.
  They are window expressions partitioned by the series key.
* *group* operators score or summarise an arbitrary set of rows (a fold, a run,
  a regime).  Such a group may hold any share of all rows, so they use only
  aggregates that combine before the shuffle and the chunked ranking of
  :mod:`seriesmill.operators.ranking`.
"""
