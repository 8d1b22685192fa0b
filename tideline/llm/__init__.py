"""Training-data operators (secret scans, packing, near-dedup, PII, licences, archives, repeats, toxicity, fingerprints, decontamination).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it can be imported.
"""
