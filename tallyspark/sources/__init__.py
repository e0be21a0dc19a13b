"""Readers of document bytes and text, page codecs, and sinks."""
