"""Training-data operators: language id, URL filters, secret scans, near-dedup,
sketches, token rollups, sharding, byte-level BPE, LM scoring, decontamination.

Nothing outside this package imports it.
"""
