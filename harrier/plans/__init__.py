"""Whole retrieval plans, made of the operators."""
