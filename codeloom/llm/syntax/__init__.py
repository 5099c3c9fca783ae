"""Grammars, lexers and parsers of source languages."""
