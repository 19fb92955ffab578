"""Training-data operators: formatting, decontamination, tokenisation, deduplication, scoring and filtering.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
