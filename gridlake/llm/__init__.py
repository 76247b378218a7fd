"""Training-data operators: filtering, deduplication, decontamination, packing and audit of text corpora.

Nothing else in ``gridlake`` imports this subpackage.
"""
