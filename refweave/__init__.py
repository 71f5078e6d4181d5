"""Code cross-reference analytics on Spark DataFrames.

Linter reports become one wide ``records`` table; every question about the code
(where is this defined, who uses it, what is at this position, what would a
rename touch) is a join over that table, answered for all files at once.
"""
