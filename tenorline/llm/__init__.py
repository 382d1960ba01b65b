"""Operators for building language-model training data with Spark.

Nothing outside this folder imports it; every operator here is a function from DataFrame to DataFrame.
"""
