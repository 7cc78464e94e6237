"""License scans: Aho-Corasick over words, and a shunting-yard reader of license expressions.

One automaton holds identifier tags and notice phrases as whole words. Behind an
identifier tag the raw text is read as an expression with and, or, with and
parentheses; ``labels`` gets the licenses it names, ``score`` how sure the notice is: a tag
counts only if a license was read behind it. Identifiers are those of ``IDENTIFIERS``, whose
labels are the same as the notices' labels, and names that begin with LicenseRef-.

Edge cases: a null text counts as empty and has no words, places or labels (base_labels and
labels are empty strings, score 0, permissive null); texts are read whole; repeated rows are read one
by one; an expression yields the identifiers before its first fault, which an unknown identifier
is as well; an empty table gives no rows; columns other than doc_id and text aren't read,
whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.llm.common import map_texts

#: Base phrases and their labels (fixed by the contract).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, their labels and how sure each is.
NOTICES = {
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "permission to use copy modify and or distribute this software": ("isc", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by 4 0": ("cc-by", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
#: Words of an identifier tag; an expression follows it.
TAGS = ("spdx license identifier",)
# Fixed values of the domain: license identifiers (lower case, without -only, -or-later and +) and their labels.
IDENTIFIERS = {
    "0bsd": "0bsd",
    "afl-3.0": "afl-3",
    "agpl-3.0": "agpl",
    "apache-1.1": "apache-1.1",
    "apache-2.0": "apache-2",
    "artistic-2.0": "artistic-2",
    "bsd-2-clause": "bsd-2-clause",
    "bsd-3-clause": "bsd-3-clause",
    "bsl-1.0": "bsl",
    "cc-by-3.0": "cc-by",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-nd-4.0": "cc-by-nc-nd",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "cddl-1.0": "cddl",
    "epl-1.0": "epl",
    "epl-2.0": "epl",
    "eupl-1.2": "eupl",
    "gfdl-1.3": "gfdl",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "isc": "isc",
    "lgpl-2.0": "lgpl",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "mit": "mit",
    "mit-0": "mit-0",
    "mpl-1.1": "mpl",
    "mpl-2.0": "mpl",
    "ms-pl": "ms-pl",
    "ncsa": "ncsa",
    "odbl-1.0": "odbl",
    "ofl-1.1": "ofl",
    "postgresql": "postgresql",
    "psf-2.0": "psf",
    "python-2.0": "python",
    "unicode-dfs-2016": "unicode",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "zlib": "zlib",
}
# Fixed values of the domain: exceptions that may stand behind "with".
EXCEPTIONS = (
    "autoconf-exception-3.0",
    "bison-exception-2.2",
    "classpath-exception-2.0",
    "font-exception-2.0",
    "gcc-exception-3.1",
    "linux-syscall-note",
    "llvm-exception",
    "openssl-exception",
    "universal-foss-exception-1.0",
)
#: Labels of licenses without conditions on derived works.
PERMISSIVE = frozenset({"0bsd", "afl-3", "apache-1.1", "apache-2", "artistic-2", "bsd", "bsd-2-clause", "bsd-3-clause", "bsl", "cc-by", "cc0", "isc", "mit", "mit-0", "ms-pl", "ncsa", "postgresql", "psf", "public-domain", "python", "unicode", "unlicense", "wtfpl", "zlib"})
BASE_SURE, TAG_SURE = 0.95, 1.0

#: A-Z become a-z, the other ASCII characters outside 0-9 and a-z become spaces, the rest stays.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_TAG = re.compile(r"(?ai)spdx-license-identifier\s*:\s*([^\r\n]*)")
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str, exception: bool = False) -> str | None:
    """The label of a license identifier, or the name of an exception; None if it isn't known."""
    low = identifier.lower()
    if exception:
        return low if low in EXCEPTIONS else None
    if low.startswith("licenseref-"):
        return low
    for end in ("-or-later", "-only", "+"):
        low = low.removesuffix(end)
    return IDENTIFIERS.get(low)


def expression(text: str) -> tuple[list, bool]:
    """Postfix form of a license expression by shunting-yard, and whether all of it was read.

    Operands are labels and names of exceptions, operators the words and, or, with.
    """
    out, stack, at, operand = [], [], 0, True
    whole = True
    while m := _TOKEN.match(text, at):
        bracket, word = m.groups()
        low = (word or "").lower()
        if bracket == "(" and operand:
            stack.append("(")
        elif bracket == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append((stack.pop(),))
            stack.pop()
        elif low in _RANK and not operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append((stack.pop(),))
            stack.append(low)
            operand = True
        elif word and low not in _RANK and operand and (label := label_of(word, bool(stack) and stack[-1] == "with")):
            out.append(label)
            operand = False
        else:
            whole = False
            break
        at = m.end()
    whole &= not operand and "(" not in stack
    while stack:
        if (op := stack.pop()) != "(":
            out.append((op,))
    return out, whole


def evaluate(postfix: list, allowed: frozenset[str]) -> bool:
    """Whether a postfix expression can be met with licenses of ``allowed`` alone.

    An exception (behind ``with``) only widens the license before it. An empty
    expression isn't met.
    """
    stack: list[bool] = []
    for item in postfix:
        if isinstance(item, str):
            stack.append(item in allowed)
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            stack.append({"or": a or b, "and": a and b, "with": a}[item[0]])
    return bool(stack) and all(stack)


def identifiers(postfix: list) -> list[str]:
    """The labels that an expression names; ``with`` joins a license and its exception."""
    stack: list[list[str]] = []
    for item in postfix:
        if isinstance(item, str):
            stack.append([item])
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            stack.append([f"{x}-with-{y}" for x in a for y in b] if item[0] == "with" else a + b)
    return [x for part in stack for x in part]


def automaton():
    """Aho-Corasick over words with a space on either side."""
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for phrase, label in BASE.items():
        entries.setdefault(phrase, []).append(("base", label, BASE_SURE))
    for phrase, (label, sure) in NOTICES.items():
        entries.setdefault(phrase, []).append(("notice", label, sure))
    for phrase in TAGS:
        entries.setdefault(phrase, []).append(("tag", "", TAG_SURE))
    for phrase, what in entries.items():
        a.add_word(f" {phrase} ", (len(phrase), what))
    a.make_automaton()
    return a


def read(text: str, machine) -> tuple[int, list[tuple[int, str]], list[str], float, bool | None]:
    """Words of the text, (start word, label) of base places, all labels, the score, and whether
    every notice and expression is met by permissive licenses (None without a label)."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, labels, doubt, tag, met = [], set(), 1.0, False, True
    at, seen = 0, 0  # words before position at
    for end, (length, what) in machine.iter(line):
        start = end - length  # of the first word; the space before it is at start - 1
        seen += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        for kind, label, sure in what:
            if kind == "tag":
                tag = True
                continue
            doubt *= 1 - sure
            if kind == "base":
                places.append((seen - 1, label))
            if label:
                labels.add(label)
                met &= label in PERMISSIVE
    if tag:
        for m in _TAG.finditer(text):
            postfix = expression(m[1])[0]
            if named := identifiers(postfix):
                labels.update(named)
                met &= evaluate(postfix, PERMISSIVE)
                doubt *= 1 - TAG_SURE
    return len(words), places, sorted(labels), 1 - doubt, met if labels else None


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, base places and labels, all labels and a score, a row per row."""

    def make():
        machine = automaton()

        def function(texts):
            columns = [[] for _ in range(8)]
            for text in texts:
                n, places, labels, score, met = read(text, machine)
                starts = [p for p, _ in places]
                row = [n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(labels), score, met]
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        return function

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("permissive", T.BooleanType())]
    return map_texts(docs, ["doc_id"], fields, make)
