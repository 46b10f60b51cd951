"""File scanning and format conversion."""
