"""flowbin: Spark-native preparation, binning and classification of labelled flow records.

Sub-packages
------------
sources    flow schema, rename, CSV/parquet scans, test fixtures, results sink
functions  column expressions (IP / port classes, labels, hash units)
operators  distributed operators: ranking, frequency and numeric binning,
           rebalancing, splitting, metrics, MLlib models
plans      multi-step compositions: the binning model and the experiment sweep
streaming  applying a fitted binning model to a streaming DataFrame
"""

__version__ = "0.1.0"
