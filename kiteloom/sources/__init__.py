"""Table-valued parsers and source adapters."""
