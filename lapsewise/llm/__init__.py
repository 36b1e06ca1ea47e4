"""Operators for preparing training text: filtering, de-duplication, masking, mixing, search, formatting, extraction."""
