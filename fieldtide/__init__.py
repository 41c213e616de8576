"""Satellite time-series analytics as DataFrame -> DataFrame operators on Spark."""
