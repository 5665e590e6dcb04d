"""The registered queries of the scorer and their SQL equivalents."""
