"""Training-data operators: quality rules, tokenising, packing, chat formatting, dedup, search, WARC, URL filters."""
