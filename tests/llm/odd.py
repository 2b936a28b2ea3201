"""Texts that operators meet seldom."""

ODD = [None, "", " ", "\n\n", "a", "A  a\ta", "é È 猫 😀", "x" * 5000, "word " * 3000, "It's 12.5% <|endoftext|> !\x00?"]
