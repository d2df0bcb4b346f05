"""Rows every text operator must take."""

#: Rows that every operator must take: nulls, an empty text, blanks only, a repeated row, a very long word.
MESSY = [
    (1, "You are an idiot and a moron. The end of it."),
    (1, "You are an idiot and a moron. The end of it."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "the words of a text without an id"),
    (5, "x" * 20_000),
    (6, "Ünïcode “quoted” text, 日本語 and 🙂"),
    (7, "the words of a text without an id"),
]
