"""Operators for training-data pipelines: token files, secret scans, near-duplicates, nearest
neighbours, chat formatting, piece encoding, token counts, packing and quality.

Nothing outside this package imports it; its queries are in ``folio.llm.queries``.
"""
