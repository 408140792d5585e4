"""Texts that operators must survive."""

#: Nulls in each column, empty and white-space texts, ties, repeated rows, one very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (5, "same words here"), (6, "same words here"), (6, "same words here"), (7, "x " * 60_000), (8, "ümläut ß 中文")]
