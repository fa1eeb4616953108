"""Training-data operators: deduplication, language, media, tokenising, packing and extraction.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
