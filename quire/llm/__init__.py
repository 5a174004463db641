"""Operators on texts, names and vectors of a training corpus. Nothing outside this subpackage imports it."""
