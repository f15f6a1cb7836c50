"""Secret scans: fixed patterns, and strings in a sensitive context that zstandard cannot compress.

The second kind is found in two steps. A candidate is a run of at least 16 characters of keys and digests with a letter
and a digit, less than 48 characters behind a sensitive word, or behind another run in such a context with only dots,
line breaks, quotes and the like between, as in PEM blocks and tokens of several parts. Its novelty is what it adds to the compressed size of the
text around it, as a share of what random strings of the same length and alphabet add in the same place, with a
compressor primed by a dictionary of identifiers and by some prose: identifiers, paths and repeated values cost
less, random keys as much, whatever their length and alphabet. Candidates that cost enough are reported as `novel` unless
a span of a fixed pattern already covers them.

The dictionary has a fixed part and one learnt from the corpus: the words that the identifiers of all its texts are made of,
those that most texts have, up to a fixed number. Words without digits only, so a key that many copies repeat is not learnt.

Positions count code points; ends are exclusive. Defined results: null text counts as empty; texts of any length are
scanned whole; every row gives a row, repeated ones too; words that as many texts have are learnt in the order of the
alphabet; an empty table gives an empty result; extra columns are ignored by find_secrets and kept by redact_secrets.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ["assign", "access", "hex", "novel"]
SPAN = "array<struct<kind:string,start:int,end:int,novelty:double>>"

# The patterns, and the words of the sensitive context.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|signing|encryption|client|account)[\x20_-]?key|credential|authorization|bearer", re.ASCII | re.IGNORECASE)
# What may stand between the pieces of one secret (it has a dot, a line break, a quote or a backslash), and a short last line.
BETWEEN = r"""(?:[.\s"'`+,]|\\[nrt]?+){1,32}"""
LINK = re.compile(rf"""(?=[^.\r\n"'`\\]*[.\r\n"'`\\]){BETWEEN}""")
LAST_LINE = re.compile(rf"{BETWEEN}?((?=[+/=]*[A-Za-z0-9])[A-Za-z0-9+/=]{{1,15}}){BETWEEN}?-----END")
#: A piece of a chain needs no digit if it is as long.
LONG_PIECE, LINK_CHARS = 40, 64
#: What identifiers and settings look like; the compressor starts from it.
IDENTIFIERS = (
    "import from return class def function const let var public private static final void string int float bool true false null none self this "
    "password passwd passphrase secret token api_key apikey access_key secret_key private_key client_id client_secret credential authorization bearer "
    "username user_name user_id account host hostname localhost port url http:// https:// www .com .org .net /usr/local/bin/ /etc/ /home/ config settings "
    "environment production staging development example default value name id key index count length size path file directory version release "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX ---------------- ================ ________________"
)
#: Stands before the surroundings, so that short ones don't leave a candidate's letters uncompressed.
PROSE = (
    "When the morning train finally reached the little harbour, nobody on the platform knew why it had been so late. A few people asked the driver, who only smiled and said that snow had covered the hills again. "
    "By noon the shops were open, children played along the quay, and an old man explained how 12 boats were built here in 1907, before the Great Bridge joined both sides of the valley. "
    "Later that week they walked up to the mill, where flour is still ground on Thursdays; from its roof one sees 3 churches, the long beach and, if the air is clear, even the lighthouse beyond. "
)
BEHIND, AROUND = 48, 256
#: A candidate of n characters has to cost 1 - MOST_LESS / sqrt(n) of what random strings cost, as costs of random ones vary by that.
MOST_LESS, LEAST_BYTES, REFERENCES = 0.8, 9, 4

#: Names of several words, joined or in camel case; and how many of their words are learnt at most.
#: They begin where letters and digits begin, and never give characters back, so long runs are read once.
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[A-Za-z][A-Za-z0-9]*+(?:[_./-][A-Za-z0-9]++)++|[A-Za-z]?[a-z]++(?:[A-Z][a-z]++)++)"
LEARNT = 2000

_primed: dict[tuple[str, ...], zstandard.ZstdCompressor] = {}


def identifier_words(docs: DataFrame, text_col: str = "text", most: int = LEARNT) -> tuple[str, ...]:
    """The words that identifiers of most texts are made of, the commonest last (where a compressor finds them soonest)."""
    names = F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")))
    words = F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: F.length(w).between(3, 20)))
    often = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("texts")).filter("texts > 1")
    return tuple(r["word"] for r in often.orderBy(F.desc("texts"), "word").limit(most).collect())[::-1]


def _compressed(text: str, learnt: tuple[str, ...]) -> int:
    if learnt not in _primed:
        content = (" ".join(learnt) + " " + IDENTIFIERS).encode()
        _primed.clear()
        _primed[learnt] = zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return len(_primed[learnt].compress(text.encode()))


def alphabet_of(said: str) -> str:
    """The alphabet of keys that a string belongs to: hexadecimal, base32, or all characters of each kind that occurs."""
    low, up = any(c.islower() for c in said), any(c.isupper() for c in said)
    letters = string.ascii_lowercase * low + string.ascii_uppercase * up
    digits = string.digits if any(c.isdigit() for c in said) else ""
    if not low or not up:
        if all(c in string.hexdigits for c in said):
            return digits + letters[:6]
        if not set(said) - set(letters + "234567"):
            return "234567" + letters
    return digits + letters + "".join(pair for pair in ("+/", "_-") if set(pair) & set(said))


def novelty(before: str, candidate: str, after: str, learnt: tuple[str, ...] = ()) -> tuple[int, float]:
    """Compressed bytes of the surroundings with the candidate less those without it, and these bytes as a share of what
    random strings of its length and alphabet cost; these follow from the candidate, so equal texts give equal results."""
    around = PROSE + before + after
    without = _compressed(around, learnt)
    cost = _compressed(around + candidate, learnt) - without
    body = candidate.rstrip("=")
    kinds, rng = alphabet_of(body), random.Random(zlib.crc32(candidate.encode()))
    table = bytes(ord(kinds[i * len(kinds) // 256]) for i in range(256))
    drawn = sum(_compressed(around + rng.randbytes(len(body)).translate(table).decode() + candidate[len(body) :], learnt) - without for _ in range(REFERENCES))
    return cost, cost * REFERENCES / max(drawn, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in no order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def spans_of(text: str, learnt: tuple[str, ...] = ()) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind as listed. learnt: see identifier_words."""
    out = [(*s, None) for s in base_spans(text)]
    fixed = list(out)
    chain, token, found = -1, [], False  # where the last run in a sensitive context ended; its neighbours with only dots between
    for m in CANDIDATE.finditer(text):
        said, (a, b) = m.group(), m.span()
        linked = 0 <= chain and a - chain <= LINK_CHARS and LINK.fullmatch(text, chain, a) is not None
        covered = [k for s, k, e, _ in fixed if s <= a and b <= e]
        if not (linked or 0 in covered or CONTEXT.search(text, max(0, a - BEHIND), a)):
            continue
        if not linked or text[chain:a] != ".":
            token, found = [], False
        chain = b
        letter, digit = any(c.isalpha() for c in said), any(c.isdigit() for c in said)
        if covered or not letter or not (digit or linked and len(said) >= LONG_PIECE):
            continue
        cost, share = novelty(text[max(0, a - AROUND) : a], said, text[b : b + AROUND], learnt)
        token.append((a, 3, b, share))
        found |= cost >= LEAST_BYTES and share >= 1 - MOST_LESS / len(said) ** 0.5
        if found:  # a token's parts are reported together
            out += token
            token = []
            if last := LAST_LINE.match(text, b):
                out.append((last.start(1), 3, last.end(1), share))
    return [(KINDS[k], a, b, x) for a, k, b, x in sorted(out, key=lambda s: s[:2])]


def redacted(text: str | None, learnt: tuple[str, ...] = ()) -> str | None:
    """The text with each secret, overlapping ones together, replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b, _ in spans_of(text or "", learnt):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:] if at else text


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learnt: Sequence[str] | None = None) -> DataFrame:
    """The id of each document and `spans`, array of struct(kind, start, end, novelty). learnt: words of identifiers, taken
    from the documents if not given."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = identifier_words(docs, text_col) if learnt is None else tuple(learnt)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
        for batch in pieces(batches):
            found = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in spans_of(t or "", known)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPAN}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", learnt: Sequence[str] | None = None) -> DataFrame:
    """The same documents and columns, with secrets replaced in the text."""
    known = identifier_words(docs, text_col) if learnt is None else tuple(learnt)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array([redacted(t, known) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)
