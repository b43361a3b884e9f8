"""Training-data operators: media, quality, chat, packing, mixing, near-duplicates, URLs, vectors, archives, pieces."""
