"""Readers and writers: message files and streams, CSV logs, publishing, table storage."""
