"""Secret scans: base patterns, and zstandard novelty of strings in sensitive context.

The code around a candidate near a sensitive word is compressed without and with it, primed with a
dictionary of common identifiers; the bytes that it adds are its marginal size.
Strings that code and dictionary don't explain are reported as kind ``novel``: their
marginal size comes near the entropy of random strings of their alphabet. Every
candidate is compressed, also letters alone; a long word of prose in such a place can be
reported too.

Edge cases: a null text counts as empty (no spans, counts 0, the digest of an empty string) and
stays null when spans are masked; an empty table gives no rows; columns other than doc_id and text aren't
read by the report, and the mask leaves them as they are; texts are scanned whole; repeated
rows are scanned one by one; an overlap of kinds is reported for each kind; of a novel
token only what no base span covers is reported; it is reported whole if one of its
pieces is novel; a token without quotes is of ASCII and Latin characters.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.llm.common import map_rows, map_texts

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer is dropped whole, so this finds the same runs
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows them sensitive, and the whole token after them: up to the closing quote or white space.
SENSITIVE = re.compile(
    r"""(?ai)(?:pwd|passphrase|credential|bearer|authorization|auth|private_?key|access_?key|client_?key|signing_?key|signature|session_?id|cookie)[a-z_]{0,12}["'`]?(?:[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+|[\x20\t]++)"""
    r"""(?:["'`]?(?:basic|bearer|digest|negotiate|ntlm|oauth|dpop|token|api-?key|aws4-hmac-sha256)(?:[\x20\t]++|(?=["'`])))?"""
    r"""(?:"([^\s"]{16,})|'([^\s']{16,})|`([^\s`]{16,})|([!#-&(-_a-~\xa1-\u024f]{16,}))"""
)
#: Parts of a token that are judged by themselves where its whole is explained.
PIECE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters at a token's end in which the context of the next one can begin.
TAIL = 48
#: Fixed identifiers that prime the compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 "
    "access_key api_key auth_token authorization bearer client_id client_secret config connection "
    "credentials database default description development document example_key environment "
    "filename function identifier implementation import_module initialize instance interface "
    "localhost password placeholder private_key production public_key repository response "
    "secret_key service session_id signature string_value test_value token username version "
    "your_api_key_here xxxxxxxxxxxxxxxx changeme undefined null true false"
)
CONTEXT, NOVEL_SHARE, RANDOM_SHARE, NOVEL_BYTES = 256, 0.6, 0.9, 12
_L, _U, _D = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Alphabets of keys, the smallest first.
ALPHABETS = [frozenset(x) for x in (_D, _D + "abcdef", _D + "ABCDEF", _L, _U, _D + _L, _D + _U, _L + _U, _D + _L + _U, _D + _L + _U + "+/_-=", _D + _L + _U + string.punctuation)]


@functools.cache
def compressor(identifiers: str):
    """A function that compresses bytes with a dictionary of ``identifiers``."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def novelty(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that ``candidate`` adds to the compressed code around it.

    A short string alone would be stored as it is; behind the code it can use what the compressor has of it.
    """
    squeeze, code = compressor(identifiers), (around + "\n").encode("utf-8", "surrogatepass")
    return len(squeeze(code + candidate.encode("utf-8", "surrogatepass"))) - len(squeeze(code))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns' matches; a match that is too short is dropped."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def entropy(value: str) -> float:
    """Bytes that a random string of this length takes in the smallest of ``ALPHABETS`` that has its characters."""
    used = set(value)
    return len(value) * math.log2(next((len(x) for x in ALPHABETS if used <= x), 256)) / 8


def novel(value: str, around: str) -> bool:
    """Whether its context leaves as much of ``value`` unexplained as of a random string, or ``NOVEL_SHARE`` of it."""
    return novelty(value, around) >= max(NOVEL_BYTES, min(NOVEL_SHARE * len(value), RANDOM_SHARE * entropy(value)))


def novel_spans(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Incompressible tokens in sensitive context, without what spans of ``taken`` cover."""
    found, m = [], SENSITIVE.search(text)
    while m:
        start, end = m.span(m.lastindex)
        m = SENSITIVE.search(text, max(start, end - TAIL))
        free, at = [], start
        for a, _, b in sorted(taken + found):
            if a < end and at < b:
                free.append((at, a))
                at = b
        free = [(a, b) for a, b in [*free, (at, end)] if re.search(r"\w", text[a : min(b, end)])]
        if not free:
            continue
        around = text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT]
        value = text[start:end]
        if novel(value, around) or any(novel(x[0], around) for x in PIECE.finditer(value) if x[0] != value):
            found += [(a, "novel", b) for a, b in free]
    return found


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans, by start and then kind."""
    key = lambda s: (s[0], KINDS.index(s[1]))
    base = sorted(base_spans(text), key=key)
    return base, sorted(base + novel_spans(text, base), key=key)


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at, i, spans = [], 0, 0, sorted(spans)
    while i < len(spans):
        start, end = spans[i][0], spans[i][2]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], mark]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the base spans' digest and all spans, a row per row."""

    def function(texts):
        columns = [[] for _ in range(5)]
        for text in texts:
            base, spans = scan(text)
            kinds = [k for _, k, _ in base]
            row = [*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)]
            for column, value in zip(columns, row):
                column.append(value)
        return columns

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_texts(docs, ["doc_id"], fields, lambda: function)


def redact_secrets(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every reported span masked; rows and columns stay, ``length`` follows the text."""

    def function(texts):
        return None, [redact(t, spans) if (spans := scan(t)[1]) else t for t in texts]

    return map_rows(docs, lambda: function, length=length)
