"""Operators for preparing training text: ten of them, each in a module of its own.

``frond.llm.queries`` registers one query per operator; nothing outside this subpackage imports it.
"""
