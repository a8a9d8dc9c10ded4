"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; every module here is a
``DataFrame -> DataFrame`` operator over tables such as ``documents``.
"""
