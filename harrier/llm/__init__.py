"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; each operator is one module and
``queries`` binds them to the driver's tables.
"""
