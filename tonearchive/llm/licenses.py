"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; expressions are evaluated by a shunting-yard parser."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_batches

#: Phrases of the base scan where none are given, as words, with their labels (fixed values).
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases of this scan, with their labels (fixed values).
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG, TAG_TEXT = "spdx license identifier", "spdx-license-identifier"
#: First parts of common licence identifiers (fixed values): such a name is one even where prose follows it.
FAMILIES = (
    "0bsd afl agpl apache apl artistic bsd bsl bzip2 cc cc0 cddl cecill cpl curl ecl epl eupl fsfap ftl gfdl gpl hpnd icu ijg isc jpl json lgpl libpng lppl mit mpl ms naist ncsa "
    "nist odbl odc ofl oldap openssl osl pddl php postgresql psf python qpl ruby sgi sleepycat ssh tcl unicode unlicense upl vim w3c wtfpl x11 xnet zlib zpl licenseref documentref"
).split()
#: Values that say that nothing is said (fixed values).
NOTHING = frozenset({"none", "noassertion"})
#: Labels under which texts may be used without asking, in ``evaluate``'s default.
OPEN = frozenset({"mit", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "cc0-1.0", "cc-by-4.0", "unlicense"})

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word signs are digits, letters and all bytes beyond ASCII; everything else separates words.
_WORDS = bytes(_LOWER[c] if _LOWER[c] >= 128 or 48 <= _LOWER[c] <= 57 or 97 <= _LOWER[c] <= 122 else 32 for c in range(256))
_VALUE = re.compile(r"[^\S\n]*+:[^\S\n]*+([a-z0-9.+()\x20\t:/-]+)", re.ASCII)
_NAME = re.compile(rf"(?:(?:{'|'.join(FAMILIES)})(?:[-.:][a-z0-9.:-]+)?|[a-z0-9.:-]*[a-z][a-z0-9.:]*-v?[0-9][a-z0-9.:-]*)\+?")
_EXCEPTION = re.compile(r"[a-z0-9.-]*(?:exception|note|linking|special|font|mif|shl|runtime)[a-z0-9.-]*|additionref-[a-z0-9.-]+")
_PIECE = re.compile(r"[()]|(?<=[a-z0-9.+)])/(?=[a-z0-9(])|[a-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def identifier(name: str, exception: bool = False) -> bool:
    """Whether a lower-cased word has the form of a licence identifier (a common name, or one with a version), or of an exception's."""
    return bool((_EXCEPTION if exception else _NAME).fullmatch(name))


def _pieces(expression: str) -> tuple[list[str], list[bool]]:
    """Brackets, operators and words of an expression, lower-cased, and whether a sentence ends after each. A slash between words is an ``or``."""
    found = ["or" if p == "/" else p for p in _PIECE.findall(expression.lower())]
    words = [p.rstrip(".:") or p for p in found]
    return words, [w != p for w, p in zip(words, found, strict=True)]


def _operand(pieces: list[str], ends: list[bool]) -> Callable[[int], bool]:
    """Tells operands from prose by place and form: whatever its name, a word counts before an operator, a bracket or the end; elsewhere it must look like an identifier."""

    def known(at: int) -> bool:
        name, exception = pieces[at], at > 0 and pieces[at - 1] == "with"
        after = pieces[at + 1] if at + 1 < len(pieces) and not ends[at] else ")"
        return name not in NOTHING and (after == ")" or after in _BINDS or identifier(name, exception))

    return known


def _yard(pieces: list[str], known: Callable[[int], bool] | None = None, start: int = 0) -> tuple[int, list[str] | None]:
    """Where the longest expression from ``start`` on ends (at ``start``: there is none), and the postfix order of all pieces if they are one.

    With ``known`` an operand that it does not accept (told its place) ends what is read.
    """
    output: list[str] = []
    waiting: list[str] = []
    operand, depth, whole = True, 0, start  # an operand is due; parentheses are open
    for at in range(start, len(pieces)):
        piece = pieces[at]
        if operand != (piece not in _BINDS and piece != ")"):
            return whole, None
        if piece == "(":
            waiting.append(piece)
            depth += 1
        elif piece == ")":
            if not depth:
                return whole, None
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif piece in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[piece]:
                output.append(waiting.pop())
            waiting.append(piece)
            operand = True
        elif known and not known(at):
            return whole, None
        else:
            output.append(piece)
            operand = False
        if not operand and not depth:
            whole = at + 1
    return whole, output + waiting[::-1] if start < whole == len(pieces) else None


def parse(expression: str) -> list[str] | None:
    """A licence expression in postfix order, by shunting-yard, or None if it isn't one.

    ``with`` binds closest, then ``and``, then ``or``; all from the left.
    """
    return _yard(_pieces(expression)[0])[1]


def longest(expression: str) -> list[str] | None:
    """As ``parse``, of the longest beginning that is an expression, whatever its operands."""
    pieces = _pieces(expression)[0]
    return _yard(pieces[: _yard(pieces)[0]])[1]


def expressions_of(value: str) -> list[list[str]]:
    """The expressions at the beginning of a tag's value, in postfix order: one as a rule, or several in a row if each begins with what looks like an identifier."""
    pieces, ends = _pieces(value)
    known, found, at = _operand(pieces, ends), [], 0
    while at < len(pieces) and (not at or identifier(pieces[at])):
        upto = _yard(pieces, known, at)[0]
        if upto == at:
            break
        found.append(_yard(pieces[at:upto])[1])
        at = upto if not ends[upto - 1] else len(pieces)
    return found


def evaluate(postfix: list[str], allowed: Callable[[str], bool] = OPEN.__contains__) -> bool:
    """Whether the expression can be met by allowed licences: ``and`` needs both, ``or`` either; an exception only adds rights."""
    stack: list = []
    for piece in postfix:
        if piece in _BINDS:
            b, a = stack.pop(), stack.pop()
            if piece == "with":
                stack.append(a)
            else:
                a, b = (x if isinstance(x, bool) else allowed(x) for x in (a, b))
                stack.append(a and b if piece == "and" else a or b)
        else:
            stack.append(piece)
    return stack[0] if isinstance(stack[0], bool) else allowed(stack[0])


def names(postfix: list[str]) -> set[str]:
    """The licences that an expression names, exceptions left out."""
    stack: list[set[str]] = []
    for piece in postfix:
        if piece in _BINDS:
            b, a = stack.pop(), stack.pop()
            if piece != "with":
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
            stack.append(a)
        else:
            stack.append({piece})
    return stack[0]


@functools.lru_cache(maxsize=4)
def _built(base: tuple[tuple[str, str], ...]):
    """Automata of the phrases (words of a text stand between single blanks, read as Latin-1; so do the phrases) and of the tag as it is written."""
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, **dict(base), TAG: ""}.items():
        phrases.add_word(f" {phrase} ", (phrase, label))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    tags.add_word(TAG_TEXT, TAG_TEXT)
    tags.make_automaton()
    return phrases, tags


def scan(text: str, base_phrases: dict[str, str] = BASE) -> dict:
    phrases, tags = _built(tuple(base_phrases.items()))
    words = text.encode().translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base_at, base, found, tagged = [], set(), set(), False
    blanks = counted = 0  # blanks before the end of the last match: a phrase's first word is as many, less its own words
    for end, (phrase, label) in phrases.iter(joined):
        if phrase == TAG:
            tagged = True
        elif phrase in base_phrases:
            blanks, counted = blanks + joined.count(" ", counted, end), end
            base_at.append(blanks - phrase.count(" ") - 1)
            base.add(label)
        elif end != counted:  # else the end of the base phrase just met (the longest comes first)
            found.add(label)
    expressions, usable = [], []
    if tagged:
        lower = text.encode().translate(_LOWER).decode("latin-1")
        places = [end + 1 for end, _ in tags.iter(lower)]
        for at, following in zip(places, [*places[1:], len(lower) + len(TAG_TEXT)], strict=False):
            value = _VALUE.match(lower, at, following - len(TAG_TEXT))  # a value ends before the next tag
            for postfix in expressions_of(value[1]) if value else ():
                expressions.append(" ".join(postfix))
                usable.append(evaluate(postfix))
                found |= names(postfix)
    return {
        "n_words": len(words), "n_base": len(base_at), "first_word": min(base_at, default=None), "last_word": max(base_at, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | found)), "score": 1 - (0.2 if base_at else 1.0) * (0.3 if found else 1.0) * (0.05 if expressions else 1.0), "expressions": expressions, "open": all(usable) if usable else None,
    }


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("open", pa.bool_())]
)


def find_licenses(docs: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, score, tag expressions (postfix) and whether all can be met by open licences.

    The score is 1 less the product of what each kind of evidence leaves open: 0.2 for base
    phrases, 0.3 for other notices or names, 0.05 for a parsed tag. Null and empty texts have
    no words, empty labels and score 0. Repeated rows stay; an empty table gives none.
    ``base`` gives the base phrases, as lower-cased words with single blanks, and their labels;
    phrases of ``BASE`` that are not among them count as other notices.
    """

    def run(rows: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([{"doc_id": d} | scan(t, base) for d, t in zip(rows["doc_id"], rows["text"], strict=True)], _RESULT)

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, open boolean"
    return map_batches(documents(docs), run, kind)
