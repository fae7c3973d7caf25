"""Retail-media campaign measurement expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns one DataFrame, keyed by
``campaign_id`` so that one job covers all campaigns at once.
"""
