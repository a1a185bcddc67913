"""Operators for preparing training text: scoring, near-duplicates, secrets, tokens, packing, urls and html.

Nothing else in the package imports this one. Conventions shared by all operators: input columns are named by
parameters and only those are read, so extra columns cannot clash; rows with a null text count as empty text;
identical rows are kept apart unless a docstring says otherwise; an empty table gives an empty result.
"""
