"""Training-data operators over tables of documents and conversations.

Nothing outside this subpackage imports it.
"""
