"""Licence scans.

One Aho-Corasick automaton holds identifier tags and notice phrases as sequences of words and runs over the words of
each text, joined by blanks. What follows an identifier tag and a colon or equals sign is a licence expression: a
shunting-yard parser turns it into postfix form with the precedence WITH, AND, OR and evaluates it. An operand must be an
identifier of a known family, or a LicenseRef; a tag with anything else gives no label and counts as unknown. A stroke
between operands is an OR. An expression is as long as it is well formed: "MIT and so on" is MIT.

A text that is null or has no words gives zero counts, null word places, empty labels and score 0. Texts are scanned
whole, one at a time, so memory is bounded by the longest text. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE

#: Phrase to label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that this scan knows besides.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved": "reserved",
}
#: Families of SPDX identifiers, without versions and the endings of family().
FAMILIES = frozenset(
    """0bsd aal afl agpl apache apl apsl artistic beerware blueoak bsd bsl bzip2 cc0 cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa
    cc-by-nd cc-by-sa cddl cecill clartistic cpal cpl curl ecl efl epl etalab eupl ftl gfdl gpl hpnd icu ijg imagemagick
    info-zip intel ipl isc jasper lgpl libpng lppl mit mpl ms-pl ms-rl mulanpsl naist ncsa ngpl nist odbl odc-by ofl
    ogl ogl-uk openssl osl pddl php postgresql psf python qpl ruby sgi-b sissl sleepycat spl unicode unicode-dfs unlicense
    upl vim w3c wtfpl x11 xnet zlib zpl""".split()
)
#: SPDX identifiers of exceptions that don't hold the word exception.
EXCEPTIONS = frozenset(("gpl-cc-1.0", "linux-syscall-note", "llgpl", "shl-2.0", "shl-2.1"))
TAGS = ("spdx license identifier", "license expression")

#: How freely a family may be used, from 0 (not at all) to 1; unknown identifiers take the middle.
OPENNESS = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "reserved": 0.0,
}
WEIGHTS = {"tag": 0.99, "base": 0.9, "notice": 0.7}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AFTER_TAG = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
#: A bracket, or a word, which ends with a letter, a digit or a plus: a stop behind it is the sentence's.
_TOKEN = re.compile(r"[ \t]*(?:([()/])|([A-Za-z0-9](?:[A-Za-z0-9.+\-:]*[A-Za-z0-9+])?))")

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_notices long, expressions array<string>, openness double, n_unknown long"
)


def family(identifier: str) -> str | None:
    """The label of an SPDX identifier: 'GPL-2.0-or-later' is 'gpl', 'CC-BY-NC-4.0' 'cc-by-nc'. A LicenseRef is its own
    label, in lower case; None for what is neither."""
    low = identifier.lower()
    if re.fullmatch(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+", low):
        return low
    name = re.sub(r"(-only|-or-later|\+)$", "", low)
    for ending in ("", r"-\d+-clause(-[a-z\-]+)?$", r"-v?\d+(\.\d+)*(-[a-z]{2,3})?$", r"-v?\d+(\.\d+)*-clause$"):
        short = re.sub(ending, "", name) if ending else name
        if short in FAMILIES:
            return short
    return None


def tokenize(text: str, start: int = 0) -> tuple[list[str], bool]:
    """The longest well-formed run of expression tokens from start on its line, operators in lower case, and whether a
    word stands in it where an operand should, and is neither an identifier nor, behind WITH, an exception. Behind WITH
    such a word with a digit or a hyphen is taken for an exception nobody knows, and the expression goes on behind it."""
    found: list[str] = []
    unknown = False
    depth = whole = 0
    operand_next, at = True, start
    while m := _TOKEN.match(text, at):
        mark, word = m.groups()
        low = "or" if mark == "/" else word.lower() if word else mark
        if operand_next:
            if low == "(":
                depth += 1
            elif low in PRECEDENCE or low == ")":
                break
            elif found and found[-1] == "with":
                # What WITH names is an exception, never a licence.
                if "exception" not in low and low not in EXCEPTIONS:
                    if not re.search(r"[\d\-]", low):
                        break
                    unknown = True
            elif family(word) is None:
                return found[:whole], unknown or not found
            found.append(word or low)
            operand_next = low == "("
        elif low in PRECEDENCE:
            found.append(low)
            operand_next = True
        elif low == ")" and depth:
            depth -= 1
            found.append(low)
        else:
            break
        if not operand_next and not depth:
            whole = len(found)
        at = m.end()
    return found[:whole], unknown


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard over the tokens of a well-formed expression."""
    out: list[str] = []
    waiting: list[str] = []
    for t in tokens:
        if t in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(t)
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of a postfix expression and how freely it lets one use the text: AND takes the strictest side, OR the
    freest, WITH adds an exception and so a tenth."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, r), (left, l) = stack.pop(), stack.pop()  # noqa: E741
            if token == "with":
                stack.append((left, min(1.0, l + 0.1)))
            else:
                stack.append((left | right, min(l, r) if token == "and" else max(l, r)))
        else:
            name = family(token)  # None: an exception, which WITH drops
            stack.append(({name}, OPENNESS.get(name, 0.5)))
    return stack[0]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES), ("tag", dict.fromkeys(TAGS, "")), ("base", BASE_PHRASES)):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (kind, label, len(phrase)))
    made.make_automaton()
    return made


def scan(text: str | None, found: ahocorasick.Automaton | None = None) -> tuple:
    """The columns of SCHEMA but doc_id for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(ALNUM_TABLE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, expressions, openness = set(), set(), [], []
    n_base = n_notices = n_unknown = 0
    first = last = None
    missed = 1.0
    seen_to = seen_words = 0
    spans = None
    for end, (kind, label, length) in (found or automaton()).iter(joined):
        start = end - length
        # Ends of hits never fall back, but starts can, by less than the longest phrase.
        place = seen_words + joined.count(" ", seen_to, start) - joined.count(" ", start, seen_to)
        seen_to, seen_words = start, place
        place -= 1
        if kind == "base":
            n_base += 1
            first = place if first is None else min(first, place)
            last = place if last is None else max(last, place)
            base.add(label)
            labels.add(label)
        elif kind == "notice":
            n_notices += 1
            labels.add(label)
        else:
            if spans is None:
                spans = [m.end() for m in _WORD.finditer(text)]
            after = spans[place + joined.count(" ", start, end)]
            mark = _AFTER_TAG.match(text, after)
            if not mark:
                continue
            tokens, unknown = tokenize(text, mark.end())
            n_unknown += unknown
            if not tokens:
                continue
            postfix = to_postfix(tokens)
            got, open_to = evaluate(postfix)
            labels |= got
            openness.append(open_to)
            expressions.append(" ".join(postfix))
        missed *= 1 - WEIGHTS[kind]
    openness += [OPENNESS.get(x, 0.5) for x in labels] if not openness else []
    return (
        len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - missed, n_notices,
        expressions, min(openness, default=None), n_unknown,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, places and labels of its licence notices; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = [scan(t.as_py(), found) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS))],
                names=_NAMES,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(),
    pa.list_(pa.string()), pa.float64(), pa.int64(),
]
