"""Operators that prepare corpora for language-model training; nothing else in the library imports them."""
