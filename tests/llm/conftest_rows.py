"""Prose for tests, by number."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
POOL = [a + b for a in ("ka", "to", "mi", "ru", "se", "lo") for b in ("n", "la", "ro", "st", "vi", "m")]


def prose(i, n=90):
    rng = random.Random(i)
    return "\n".join(" ".join(rng.choice(POOL) for _ in range(15)) for _ in range(n // 15))
