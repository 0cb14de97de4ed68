"""Readers of chat exports, folders of documents and message files."""
