"""Training-data operators: licences, deduplication, quality, tokens, packing, shards, WARC, search."""
