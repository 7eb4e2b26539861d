"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; its queries live in
:mod:`flowseq.llm.queries`.
"""
