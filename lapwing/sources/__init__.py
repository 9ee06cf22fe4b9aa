"""Readers of manuscripts, bibliographies, benchmark prompts and landed responses of bibliographic services."""
