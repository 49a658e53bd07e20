"""Word segmentation, normalisation and English (Porter2) stemming."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, twice."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if word.startswith("'"):
        word = word[1:]
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    # A y that acts as a consonant is written Y.
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    for end in ("eedly", "eed"):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                rest = word[: -len(end)]
                if any(c in _VOWELS for c in rest):
                    word = rest
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLES):
                        word = word[:-1]
                    elif r1 >= len(word) and _short_end(word):
                        word += "e"
                break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for end, to in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                if end == "ogi":
                    word = word[:-1] if word[-4:-3] == "l" else word
                elif end == "li":
                    word = word[:-2] if word[-3:-2] and word[-3] in _LI else word
                else:
                    word = word[: -len(end)] + to
            break
    for end, to in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and (end != "ative" or len(word) - 5 >= r2):
                word = word[: -len(end)] + to
            break
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


#: What Unicode word segmentation (UAX #29) comes to in ASCII: letters, digits and underscores hold together, also
#: across one . : ' between letters and one . , ; ' between digits.
_ASCII_WORD = re.compile(r"[A-Za-z0-9_]+(?:(?:(?<=[A-Za-z])['.:](?=[A-Za-z])|(?<=[0-9])['.,;](?=[0-9]))[A-Za-z0-9_]+)*")


def segments(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text)
    import regex

    return [x for x in regex.split(r"(?w)\b", text, flags=regex.V1 | regex.WORD) if x]


def words(text: str) -> Iterator[str]:
    """The words of a text in order, in lower case: the segments that begin with a letter."""
    plain = text.isascii()
    for part in segments(text):
        part = part if plain else unicodedata.normalize("NFKC", part)
        if part and part[0].isalpha():
            yield part.lower()


def stems(text: str) -> list[str]:
    """Stems of a text in order; their places in the list are the word positions.

    A text without any alphabetic word is one stem, itself (normalised).
    """
    return [stem(word) for word in words(text)] or [unicodedata.normalize("NFKC", text)]


def heads(word_stem: str) -> set[str]:
    """What every word of this stem begins with: but for the listed exceptions all but the stem's last letter.

    Apostrophes are normalised by the stemmer, so where the stem has one this ends before it.
    """
    return {word_stem.split("'")[0][: len(word_stem) - 1], *(w for w, s in _EXCEPTIONS.items() if s == word_stem)}


def finder(wanted: Iterable[str]) -> Callable[[str], tuple[int, list[list[int]]]]:
    """From a text to the length of ``stems`` of it, and the places there of each wanted stem; few words are stemmed for it."""
    own = {s: k for k, s in enumerate(wanted)}
    begins = tuple(sorted(set().union(*map(heads, own))))

    def run(text: str) -> tuple[int, list[list[int]]]:
        n, found = 0, [[] for _ in own]
        for n, word in enumerate(words(text), 1):
            if word.startswith(begins) and (k := own.get(stem(word))) is not None:
                found[k].append(n - 1)
        if not n and (k := own.get(unicodedata.normalize("NFKC", text))) is not None:
            found[k].append(0)
        return n or 1, found

    return run


def _places_type(wanted: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(f"p{k}", T.ArrayType(T.IntegerType())) for k in range(len(wanted)))])


def _places(texts: pa.Array, wanted: tuple[str, ...]) -> pa.Array:
    """(n, p0, p1, ...) of each text. Texts become Python objects one at a time, places never stay such."""
    find = finder(wanted)
    sizes, missing = array("i"), array("b")
    values, ends = [array("i") for _ in wanted], [array("i", [0]) for _ in wanted]
    for item in texts:
        text = item.as_py()
        n, found = (0, [()] * len(wanted)) if text is None else find(text)
        sizes.append(n)
        missing.append(text is None)
        for k, own in enumerate(found):
            values[k].extend(own)
            ends[k].append(len(values[k]))
    flat = lambda x: pa.array(np.array(x, dtype="int32"))
    lists = [pa.ListArray.from_arrays(flat(e), flat(v)) for e, v in zip(ends, values)]
    return pa.StructArray.from_arrays([flat(sizes), *lists], ["n", *(f"p{k}" for k in range(len(wanted)))], mask=pa.array(np.array(missing, dtype=bool)))


def places_udf(wanted: Iterable[str], once: bool = False) -> Callable[[Column], Column]:
    """From a text to its number of words, ``n``, and the places p0, p1, ... of the wanted stems.

    The other words never leave the function, so what goes back to Spark and what a worker holds besides its input is
    small. ``once`` keeps Spark from running it once more for each step that reads the places.
    """
    wanted = tuple(wanted)

    def run(texts: pa.Array) -> pa.Array:
        return _places(texts, wanted)

    made = F.arrow_udf(run, _places_type(wanted))
    return made.asNondeterministic() if once else made


def element_places_udf(wanted: Iterable[str], once: bool = False) -> Callable[[Column], Column]:
    """``places_udf`` for each text of an array."""
    wanted = tuple(wanted)

    def run(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), _places(lists.flatten(), wanted), mask=lists.is_null())

    made = F.arrow_udf(run, T.ArrayType(_places_type(wanted)))
    return made.asNondeterministic() if once else made


def counts_udf(wanted: Iterable[str]) -> Callable[[Column], Column]:
    """From a text to its number of different stems, and how often each of the wanted ones stands there, in one array."""
    wanted = tuple(wanted)

    def run(texts: pa.Array) -> pa.Array:
        def counted(found: list[str]) -> list[int]:
            return [len(set(found)), *map(found.count, wanted)]

        return pa.array([None if (text := item.as_py()) is None else counted(stems(text)) for item in texts], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def _folding() -> str:
    """A character class of all beyond ASCII that normalisation or lower case turns into something with ASCII letters or digits.

    Ranges that lie near one another are joined, as each costs time at every character; some that needn't pass do.
    """
    runs: list[list[int]] = []
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        low = unicodedata.normalize("NFKC", chr(code)).lower()
        if any(c.isascii() and c.isalnum() for c in low):
            if runs and code - runs[-1][1] <= (1 if code < 0xC0 else 16 if code < 0x250 else 192) and not runs[-1][1] < 0xC0 <= code:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@lru_cache(maxsize=1)
def folding() -> str:
    return _folding()


def may_have(text: Column, word_stem: str) -> Column:
    """A cheap JVM test that is true for every text with a word of this stem: sound for all of Porter2's rules.

    But for the listed exceptions a stem shares all but its last letter with the word; texts with a character that
    normalisation may turn into ASCII letters always pass.
    """
    sources = [w for w, s in _EXCEPTIONS.items() if s == word_stem]
    probes = {word_stem[: max(1, len(word_stem) - 1)], *(w[:2] for w in sources)}
    if not word_stem.isascii() or len(word_stem) <= 2:
        return F.lit(True)
    found = None
    for probe in sorted(probes):
        has = F.contains(F.lower(text), F.lit(probe))
        found = has if found is None else found | has
    return found | (F.octet_length(text) > F.char_length(text)) & F.rlike(text, F.lit(folding()))
