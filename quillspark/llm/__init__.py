"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage, but for components and scratch, which fingerprints use, and words, which records use, and for scratch in plans.
"""
