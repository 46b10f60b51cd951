"""Operators for preparing training text: fingerprints, token files, language id, quality rules,
packing, similarity join, source mixing, substring and line removal, page extraction.

Nothing outside this subpackage imports it.  See ``queries.py`` for the registered queries.
"""
