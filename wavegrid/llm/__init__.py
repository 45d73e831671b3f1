"""Training-data operators: decontamination, token files, archives, media, shards, quality, deduplication and tokenizers.

Nothing else in the library imports this subpackage.
"""
