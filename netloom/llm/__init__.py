"""Operators for training-data pipelines: packing, near duplicates, shards, chats, filters, models, search."""
