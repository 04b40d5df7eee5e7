"""Column functions: text in, text, flag or violations out. No shuffles here."""
