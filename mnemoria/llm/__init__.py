"""Training-data operators for very large corpora.

Nothing else in :mod:`mnemoria` imports this subpackage; it may be deleted as a whole.
"""
