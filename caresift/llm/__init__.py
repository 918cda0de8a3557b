"""Operators of a training-data pipeline: filters, near duplicates, decontamination, mixing and materialisation.

Nothing outside this subpackage imports it.  ``queries`` registers every operator on the test tables.
"""
