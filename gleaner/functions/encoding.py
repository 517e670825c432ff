"""Text that was UTF-8 and was read as something else, once or several times: found by search, judged by a cost.

Every byte from 80 on is no ASCII character in any of the encodings, so damage shows as runs of such characters.  For each
run the chains of wrong readings that could have made it are undone, and the cheapest outcome stays; a run that is
as cheap as it stands is left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

MAX_CHAIN = 3
MEMORY, LONGEST = 50_000, 64  # runs whose outcome a worker remembers, and characters up to which it does
IMPLAUSIBLE = 10
#: What it costs to take a run of Latin letters alone for damage by a rarer encoding: three of them may well be meant.
LETTERS_ONLY = 2.5

# The encodings that text is read in by mistake; the later two are believed on more evidence only.
ENCODINGS = ("windows-1252", "latin-1", "mac-roman", "windows-1251")
STRONG = {"windows-1252", "latin-1"}

# Unicode ranges of letters and signs that texts are usually written in.
PLAUSIBLE = (
    (0x00A0, 0x017F),  # Latin
    (0x0386, 0x03CE),  # Greek
    (0x0400, 0x045F),  # Cyrillic
    (0x0490, 0x0491),  # Cyrillic, Ukrainian
    (0x05D0, 0x05EA),  # Hebrew
    (0x0620, 0x0652),  # Arabic
    (0x0900, 0x0DFF),  # scripts of India
    (0x0E01, 0x0E5B),  # Thai
    (0x1E00, 0x1EFF),  # Latin, Vietnamese
    (0x2010, 0x2027),  # punctuation
    (0x202F, 0x205E),
    (0x20A0, 0x20BF),  # currencies
    (0x2100, 0x214F),  # letter-like signs
    (0x2190, 0x22FF),  # arrows and mathematics
    (0x2500, 0x27BF),  # shapes and symbols
    (0x3000, 0x30FF),  # Japanese
    (0x4E00, 0x9FFF),  # Chinese characters
    (0xAC00, 0xD7A3),  # Korean
    (0xFE0F, 0xFE0F),
    (0xFF01, 0xFFEE),  # full-width forms
    (0x1F300, 0x1FAFF),  # emoji
)


def _table(encoding: str) -> dict[str, int]:
    """Characters of the bytes from 80 on; a byte without one is read as the control character of its number."""
    return {(bytes([b]).decode(encoding, "ignore") or chr(b)): b for b in range(0x80, 0x100)}


_TABLES = {name: _table(name) for name in ENCODINGS}
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _pair(table: dict[str, int]) -> str:
    first = "".join(c for c, b in table.items() if 0xC2 <= b <= 0xF4)
    later = "".join(c for c, b in table.items() if b < 0xC0)
    return f"[{re.escape(first)}][{re.escape(later)}]"


#: Runs with a pair that could begin a character of UTF-8; nothing else is looked at.
_KNOWN = re.escape("".join(sorted(set().union(*_TABLES.values()))))
_RUN = re.compile(f"[{_KNOWN}]{{2,}}")
_START = re.compile("|".join(_pair(t) for t in _TABLES.values()))


def _is_latin(char: str) -> bool:
    return char.isalpha() and "LATIN" in unicodedata.name(char, "")


def _cost(run: str) -> int:
    known = sum(any(low <= ord(c) <= high for low, high in PLAUSIBLE) for c in run)
    return known + IMPLAUSIBLE * (len(run) - known)


def _undo(run: str, encoding: str) -> str | None:
    """``run`` as it was before it was read in ``encoding``; characters that cannot come from it stay if they are no letters."""
    table = _TABLES[encoding]
    read = "".join(chr(table.get(c, 0xFF)) for c in run)
    out, at = [], 0
    for found in _UTF8.finditer(read):
        try:
            char = found.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:  # a surrogate or an overlong form
            continue
        out += [run[at : found.start()], char]
        at = found.end()
    kept = "".join(out[::2]) + run[at:]
    if not out or any(c.isalpha() for c in kept) or (kept and encoding == "windows-1251"):
        return None
    return "".join(out) + run[at:]


def _candidate(run: str) -> tuple[str, bool] | None:
    """The cheapest text behind ``run``, and whether it speaks for itself; none if the run is cheapest."""
    best, best_cost, weak = run, _cost(run), False
    chains, seen = [(run, 0, False)], {run}
    for _ in range(MAX_CHAIN):
        undone = []
        for text, extra, doubtful in chains:
            for encoding in ENCODINGS:
                before = _undo(text, encoding)
                if before is not None and before not in seen:
                    seen.add(before)
                    rare = encoding not in STRONG
                    undone.append((before, extra + LETTERS_ONLY * (rare and all(map(_is_latin, text))), doubtful or rare))
        for text, extra, doubtful in undone:
            if (cost := _cost(text) + extra) < best_cost:
                best, best_cost, weak = text, cost, doubtful
        chains = undone
    if best == run:
        return None
    letters = [c for c in best if c.isalpha()]
    foreign = not all(map(_is_latin, letters))
    sure = len(letters) > 1 or max(best) > "\uffff"  # four bytes hardly ever fit by chance
    return best, sure or not (weak or foreign)


_remembered = lru_cache(MEMORY)(_candidate)


def _fits(text: str, start: int, end: int, best: str) -> bool:
    """Whether ``best`` can stand in the run's place: one script in a word."""
    for side, char in ((text[max(start - 1, 0) : start], best[0]), (text[end : end + 1], best[-1])):
        if side.isascii() and side.isalpha() and char.isalpha() and not _is_latin(char):
            return False
    return True


def _odd(text: str, start: int, end: int, best: str) -> bool:
    """Whether ``best`` would be the one small letter at the end of a word of capitals."""
    before, after = text[max(start - 2, 0) : start], text[end : end + 1]
    return len(before) == 2 and before.isascii() and before.isupper() and before.isalpha() and best.islower() and not after.isalpha()


def _script(text: str) -> str:
    """The script of the first letter; those that stand together in one language are one."""
    name = next((unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha()), "")
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "HANGUL") else name


def repair_encoding(text: str) -> str:
    """Undo up to three wrong readings, in any of ``ENCODINGS``, of what was UTF-8.

    A single letter of another script, one read in a rarer encoding, or a small one after capitals is believed only where
    the text holds a run of that script that differs or speaks for itself.
    """
    if text.isascii():
        return text
    found = []
    for match in _RUN.finditer(text):
        run = match.group()
        if not _START.search(run):
            continue
        candidate = _remembered(run) if len(run) <= LONGEST else _candidate(run)
        if candidate and _fits(text, *match.span(), candidate[0]):
            best, sure = candidate
            found.append((*match.span(), best, sure and not _odd(text, *match.span(), best)))
    if not found:
        return text
    evident = {_script(best) for *_, best, sure in found if sure}
    different = {best for *_, best, _ in found}
    evident |= {script for script, n in Counter(map(_script, different)).items() if n > 1}
    out, at = [], 0
    for start, end, best, sure in found:
        if sure or _script(best) in evident:
            out += [text[at:start], best]
            at = end
    return "".join(out) + text[at:]
