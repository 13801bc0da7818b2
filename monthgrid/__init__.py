"""Panel (entity x month) features, evaluation and forecasting on PySpark.

``sources``    readers and writers
``functions``  scalar column expressions
``operators``  DataFrame -> DataFrame building blocks
``plans``      the three end-to-end jobs: build panel, train, forecast
"""
