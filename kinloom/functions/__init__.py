"""Scalar functions: normalisation, phonetic codes, similarities."""
