"""Column expressions: typed JSON reads, times, hashes, codecs and glob patterns."""
