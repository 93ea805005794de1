"""Training-data operators: quality, tokens, packing, secrets, duplicates, language, files.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
