"""Training-data operators: quality, privacy, duplicates, decontamination, sharding, packing, chat formats and page text.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
