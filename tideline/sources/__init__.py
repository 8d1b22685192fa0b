"""Readers and writers: news and price files, the news cache, configuration, run tracking."""
