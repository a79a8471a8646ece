"""Whole analyses put together from operators, and the size checks they rest on."""
