"""Text expressions: word counts, prompts, marker parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points Python's str.split() treats as whitespace.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null counts as no words.

    Folding every kind of whitespace to a blank first lets ``split`` take its
    literal one-character path, about twice as fast as a character-class regex.
    """
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    words = F.array_remove(F.split(blanks, " "), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def occurrences(text: Column, letter: str) -> Column:
    """How often ``letter`` occurs; byte lengths are stored, so they cost no pass over the text."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
    return (removed / len(letter.encode())).cast("int")


def after_last_marker(text: Column, marker: str = "English:") -> Column:
    """Trimmed text after the last ``marker``; the whole text when it is absent."""
    tail = F.substring_index(text, marker, -1)
    # trim() alone only removes blanks; the marker is usually followed by a newline too
    return F.trim(tail, F.lit(WHITESPACE))


def translation_prompt(language: Column, text: Column, max_chars: int = 200) -> Column:
    """Prompt ``<language>: <start of the text> English:`` for one message."""
    return F.concat(language, F.lit(": "), F.left(text, F.lit(max_chars)), F.lit(" English:"))
