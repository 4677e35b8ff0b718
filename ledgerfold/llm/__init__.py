"""Operators for preparing training data.

Each module holds one operator behind a DataFrame-in, DataFrame-out function;
``queries`` applies them to whole tables. Nothing outside this subpackage
imports it.
"""
