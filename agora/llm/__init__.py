"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries are registered by the
entry module only while the subpackage is present.
"""
