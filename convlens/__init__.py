"""Conversion analytics over labelled event tables, written as Spark jobs.

``functions``  column expressions
``operators``  DataFrame -> DataFrame operators
``sources``    readers, writers, staging and the contact view over the star schema
``plans``      the named queries, each with the SQL it is checked against
"""
