"""Operators that prepare prose for language-model training; nothing outside this folder imports it."""
