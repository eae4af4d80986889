"""Training-data operators: ten operators over documents, pages, conversations and benchmark items.

Nothing outside this subpackage (and the entry points that guard its import) uses it.
"""
