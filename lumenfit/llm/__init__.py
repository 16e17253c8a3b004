"""Training-data operators (fingerprints, dedup, packing, scans, formatting).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
