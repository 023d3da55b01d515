"""Operators for preparing large text corpora for language-model training.

Every operator takes and returns DataFrames.  Nothing outside this subpackage
imports it, so the rest of the library works without it.
"""
