"""Normal forms of texts that keep the raw span of every character, so that what is found can be quoted as it stands.

A normal form is NFKC with case folded (ß is ss) and one space for each run of white space. Offsets count code points.
"""

import re
import unicodedata
from collections.abc import Sequence
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, a run of ASCII characters, or a character with what combines with it.
CLUSTER = regex.compile(r"\s+|[!-~]+(?!\p{M})|\X")
RUNS, SPACE = re.compile(r"\s\s"), re.compile(r"\s")
#: White space as SQL engines know it.
BLANKS = re.compile(r"[ \t\n\f\r]+")
#: Full-width signs and letters by their narrow ones.
NARROW = {c + 0xFEE0: c for c in range(0x21, 0x7F)}


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


class Mapped:
    """A text's normal form, and for each of its characters the start and end of the raw characters it stands for."""

    def __init__(self, raw: str):
        self.raw = raw
        self.starts: Sequence[int]
        self.ends: Sequence[int]
        whole = raw.casefold()
        if len(whole) == len(raw) and not RUNS.search(raw) and unicodedata.is_normalized("NFKC", raw) and unicodedata.is_normalized("NFKC", whole):
            # most texts: each character stands for itself
            self.norm, self.starts, self.ends = SPACE.sub(" ", whole), range(len(raw)), range(1, len(raw) + 1)
            return
        parts: list[str] = []
        self.starts, self.ends = [], []
        for m in CLUSTER.finditer(raw):
            part, start, end = m[0], m.start(), m.end()
            if part.isspace():
                parts.append(" ")
                self.starts.append(start)
                self.ends.append(end)
            elif part.isascii():
                parts.append(part.lower())
                self.starts.extend(range(start, end))
                self.ends.extend(range(start + 1, end + 1))
            else:
                own = folded(part)
                parts.append(own)
                self.starts.extend([start] * len(own))
                self.ends.extend([end] * len(own))
        self.norm = "".join(parts)

    def quote(self, start: int, end: int) -> str:
        """The raw text of the characters from start to end of the normal form."""
        return self.raw[self.starts[start] : self.ends[end - 1]] if end > start else ""

    @cached_property
    def letters(self) -> list[int]:
        """Places of letters and digits in the normal form."""
        return [i for i, c in enumerate(self.norm) if c.isalnum()]

    @cached_property
    def bare(self) -> str:
        return "".join(self.norm[i] for i in self.letters)

    def find(self, quote: str | None) -> tuple[int, int, str] | None:
        """Where a quote first stands: as it is; else in normal form; else with all signs and spaces left out.

        Raw start and end, and which of the three it was.
        """
        if not quote or not quote.strip():
            return None
        if (at := self.raw.find(quote)) >= 0:
            return at, at + len(quote), "exact"
        wanted = Mapped(quote.strip())
        if (at := self.norm.find(wanted.norm)) >= 0:
            return self.starts[at], self.ends[at + len(wanted.norm) - 1], "normal"
        if wanted.bare and (at := self.bare.find(wanted.bare)) >= 0:
            return self.starts[self.letters[at]], self.ends[self.letters[at + len(wanted.bare) - 1]], "bare"
        return None


class Plain(Mapped):
    """A text in lower case, letter by letter, as SQL has it: ß stays ß. One space stands for each run of ASCII white space."""

    def __init__(self, raw: str):
        self.raw = raw
        lower = raw.lower()
        if len(lower) != len(raw) or "Σ" in raw:
            lower = "".join(c.lower()[0] for c in raw)
        places = [i for m in BLANKS.finditer(lower) for i in range(m.start() + 1, m.end())]
        self.norm = BLANKS.sub(" ", lower)
        if not places:
            self.starts, self.ends = range(len(raw)), range(1, len(raw) + 1)
            return
        inner = set(places)
        self.starts = [i for i in range(len(raw)) if i not in inner]
        self.ends = [*self.starts[1:], len(raw)]

    def first(self, quote: str | None) -> tuple[int, int, str] | None:
        """The first place where the letters and digits of a quote stand, in whatever case and width it has them."""
        wanted = Plain((quote or "").translate(NARROW)).bare
        at = self.bare.find(wanted) if wanted else -1
        return (self.starts[self.letters[at]], self.ends[self.letters[at + len(wanted) - 1]], "bare") if at >= 0 else None


def anchored(text: Column, quotes: Column, first: bool = False) -> Column:
    """For each of the quotes its raw form in the text, its start and how it was found; nulls where it isn't there.

    first: its first place by letters and digits alone (`Plain.first`), even if a later one has its signs and spaces too.
    A text's normal form is made once for all of its quotes. Null texts and quotes give nulls; no quote is dropped.
    """

    @F.pandas_udf("array<struct<quote string, start int, how string>>")
    def find(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, wanted, strict=True):
            mapped = Plain(t or "") if first else Mapped(t or "")
            find_one = mapped.first if first else mapped.find
            found = [find_one(q) for q in (own if own is not None else [])]
            out.append([{"quote": mapped.raw[f[0] : f[1]], "start": f[0], "how": f[2]} if f else {"quote": None, "start": None, "how": None} for f in found])
        return pd.Series(out)

    return find(text, F.coalesce(quotes, F.array().cast("array<string>")))
