"""Column functions: text cleaning, search tokens, markup, scalars."""
