"""Byte-level BPE texts cut where no token can cross, so that repeated words are worked out once.

The pre-tokenizer of the byte-level vocabularies attaches one space to the word after it and never joins
text over other white space. Between single white-space characters the words of a text are therefore
encoded independently, and a task can remember them. Texts with runs of white space, other white space
than space and line feed, or special strings are not cut.
"""

#: Remembered words of one cache, and their letters at most: a full cache starts anew and longer words (lines of text
#: without spaces) are worked out each time, so memory is bounded at some 200 MB, usually a fifth of it.
REMEMBERED, LONGEST = 300_000, 64
#: White space that keeps a text whole: two in a row, and all that Unicode or Python's re knows but space
#: and line feed. Plain searches; a regular expression takes ten times as long.
ODD = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
SPECIAL = "<|endoftext|>"
#: Fixed value: the public split pattern of the byte-level vocabularies, with white space as Unicode has it.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def words_of(text: str):
    """A text's first word, then words that each follow a space; None if the text stays whole.

    A word after a line feed starts with it instead of following a space: see :func:`plain`.
    """
    if SPECIAL in text or any(odd in text for odd in ODD):
        return None
    return text.replace("\n", " \n").split(" ")


def plain(word: str) -> str:
    """What a word other than the first stands for in its text."""
    return word if word[:1] == "\n" else " " + word


class Memory(dict):
    """word -> work(word), forgetting everything once it holds ``REMEMBERED`` words; words above ``LONGEST`` letters are
    never held. Keys other than text are."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, word):
        found = self.work(word)
        if type(word) in (str, bytes) and len(word) > LONGEST:
            return found
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found
