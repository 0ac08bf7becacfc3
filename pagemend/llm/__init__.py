"""Operators for preparing training corpora: one module per operator.

Nothing outside this subpackage imports it.  Each module has the operator with its own general interface (columns are
parameters, real outputs) and a thin ``opN_*`` query over the tables of a folder.
"""
