"""Operators for preparing training text: each module holds one operator.

Column operators take a text column and give a struct column, so whatever else a frame
holds stays as it is. Table operators name the columns they read.
"""
