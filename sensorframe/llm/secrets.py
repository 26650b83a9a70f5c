"""Secret scan: fixed patterns, plus strings that compression can't explain.

The patterns find assignments, access keys and long hex runs.  The method adds strings that stand in a sensitive
context (a word such as *key* or *credential* shortly before them, also in the name of ``name=value``) and are novel: a zstandard compressor is primed
with a dictionary of identifiers and with the text around the candidate, and the candidate's marginal bytes are
the difference that it makes to the compressed size.  A name that code around it, the dictionary, or plain letters
explain costs few bytes per character; a random key costs about as many as its entropy, which for few different
characters is less.  Copies of the candidate around it don't explain it, unless one stood before it without a sensitive
word.

Words of sensitive context count whole, or as parts of a name: *key* in ``api_key`` and ``privateKey``, not *sign* in
*design*.  A path, a URL or a dotted name is judged without the pieces between separators that are words or short
numbers; fewer than ``LEAST_LEFT`` other characters are no secret.

The dictionary is learned from the corpus: the parts of compound names (snake_case, dotted, kebab-case) in all whole
texts, counted once per document with partial sums in each task.  The ``most`` most frequent go to the driver.

Defined results: null and empty texts have no spans.  Spans are in code points, end exclusive.  Every row returns one
row, repeated or null ids too.  Extra columns are ignored.  Whole texts are scanned, with a window around each
candidate only for the context, so cost stays linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# shorter runs can't count and end where longer ones do, so the scan may skip them
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "novel"]

# Words that announce a secret; each counts as a whole word or as a part of a name (api_key, privateKey)
WORDS = (
    "accesskey apikey auth authentication authorization bearer cert certificate credential credentials key keys login pass "
    "passphrase password private privatekey pwd secret secretkey secrets signature signing token tokens"
).split()
ANY = "|".join(sorted(WORDS, key=len, reverse=True))
CAPITAL = "|".join(w.capitalize() for w in sorted(WORDS, key=len, reverse=True))
SENSITIVE = re.compile(rf"(?<![A-Za-z])(?i:{ANY})(?![A-Za-z])|(?<![A-Za-z])(?:{ANY}|{CAPITAL})(?=[A-Z][a-z])|(?<=[a-z0-9])(?:{CAPITAL})(?![a-z])", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: What stands between single ``=`` of a candidate; signs at its end pad the last value.
VALUE = re.compile(r"[A-Za-z0-9+/_.-]{16,}(?:=+\Z)?")
#: A compound name, such as snake_case, dotted.name or kebab-case; possessive, so long runs are read once.
COMPOUND = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z][A-Za-z0-9]*+(?:[_.-][A-Za-z0-9]++)++")
PART = re.compile(r"[A-Z]?[a-z]{3,15}")
#: Between separators of a path, URL or dotted name: words (also in camelCase), years and other short numbers.
PIECE = re.compile(r"[^+/_.=-]+")
PLAIN = re.compile(r"(?:[A-Z]?[a-z]{2,15}|[A-Z]{2,15})+[0-9]{0,4}|[0-9]{1,8}|[A-Za-z]")
LEAST_LEFT = 12
# What the dictionary begins with, before the corpus's own names
COMMON = (
    "account address application attribute authorization base64 bearer boolean branch bucket buffer cache callback certificate "
    "channel client column command commit component config configuration connection console constructor container content context "
    "credential customer database default description device directory document domain element email enable endpoint engine environment "
    "error event example execute export factory field filter format function github google handler header height host html https identifier "
    "image import index input instance integer interface internal javascript label language layout length library license listener localhost "
    "login manager master memory message metadata method model module namespace native network number object offset operator option output "
    "package parameter parent password path pattern payload permission platform plugin pointer policy prefix primary private process product "
    "profile project property protocol provider proxy public python query queue record reference region register release remote report request "
    "resource response result return schema script search secret section security select sequence server service session setting signature "
    "source status storage stream string system template thread timeout timestamp token transaction transform update upload username validate value variable version "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef aaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxx "
    "0000000000000000 ================ ---------------- ________________ ................"
)
IDENTIFIERS, PARTS_HELD = 1000, 200_000
NEAR, AROUND, LEAST_BYTES, LEAST_RATE = 48, 400, 10, 0.62
#: Share of the entropy of random strings over the same alphabet, and the sizes of what alphabets are made of.
LEAST_SHARE = 0.9
ALPHABETS = [(re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[^0-9A-Za-z]"), 5)]
HEXES = re.compile("[0-9a-f]+|[0-9A-F]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: leftmost non-overlapping matches of each kind, too short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Marginal compressed bytes of a string, given the text around it and the dictionary of identifiers."""

    def __init__(self, identifiers: str = ""):
        self.identifiers = f"{COMMON} {identifiers}".encode()

    def bytes_of(self, candidate: str, around: str) -> int:
        primed = zstandard.ZstdCompressionDict(self.identifiers + b"\n" + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
        lead = around[-32:].encode()
        return len(coder.compress(lead + b" " + candidate.encode())) - len(coder.compress(lead + b" "))


def least_rate(value: str) -> float:
    """Bytes a character from which a value is novel; a compressor spends less on random strings over few characters."""
    size = sum(n for kind, n in ALPHABETS if kind.search(value))
    if HEXES.fullmatch(value):
        size = min(size, 16)
    return min(LEAST_RATE, LEAST_SHARE * log2(size) / 8)


def unexplained(value: str) -> str:
    """The value without pieces that are words or short numbers; all of it where nothing separates pieces."""
    pieces = PIECE.findall(value)
    return value if len(pieces) < 2 else "".join(p for p in pieces if not PLAIN.fullmatch(p))


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Candidates in sensitive context, outside the base spans, that cost too many bytes to be a name or a word."""
    out = []
    begins = [b for b, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))
    sensitive = [m.end() for m in SENSITIVE.finditer(text)]
    if not sensitive:
        return out
    unasked: dict[str, int] = {}  # where a value stood last without a sensitive word before it, which explains it nearby

    def is_novel(begin: int, end: int) -> bool:
        k = bisect_right(sensitive, begin)
        value = text[begin:end]
        taken = bisect_left(begins, end)
        if (taken and reach[taken - 1] > begin) or not k or sensitive[k - 1] <= begin - NEAR:
            unasked[value] = begin
            return False
        if value.isalpha() and (value.islower() or value[1:].islower()):  # a word
            return False
        if len(unexplained(value)) < LEAST_LEFT:  # a path, a URL or a name
            return False
        # copies at the places of the window are blanked, those cut by its edge too
        blank, far = "\n" * len(value), AROUND + len(value)
        before = text[max(0, begin - far) : begin]
        if value not in unasked or unasked[value] < begin - AROUND:
            before = before.replace(value, blank)
        cost = novelty.bytes_of(value, before[-AROUND:] + text[end : end + far].replace(value, blank)[:AROUND])
        return cost >= LEAST_BYTES and cost >= least_rate(value) * len(value)

    for m in CANDIDATE.finditer(text):
        # values behind a leading name, whose words are context, else the whole
        values = [(m.start() + v.start(), m.start() + v.end()) for v in VALUE.finditer(m[0]) if m[0].find("=", 0, v.start()) >= 0]
        found = [v for v in values if is_novel(*v)] or [v for v in [m.span()] if is_novel(*v)]
        out += [(begin, end, "novel") for begin, end in found]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def name_parts(text: str) -> set[str]:
    """Lower-cased parts of the compound names in a text."""
    return {p.lower() for name in COMPOUND.findall(text) for p in PART.findall(name)}


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["part", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(name_parts(text or ""))
            if len(held) >= PARTS_HELD:
                yield counted()
                held.clear()
    yield counted()


def common_identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> str:
    """The name parts that most documents hold, rarest first, as a compressor favours what lies near the end."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_count_parts, "part string, n long")
    top = parts.groupBy("part").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "part").limit(most)
    return " ".join(r.part for r in reversed(top.collect()))  # at most ``most`` words


def _scanner(identifiers: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            base, added = [], []
            for text in batch.column("text").to_pylist():
                base.append(base_spans(text or ""))
                added.append(novel_spans(text or "", base[-1], novelty))
            spans = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(base, added, strict=True)]
            counts = {k: pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts.values(), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]),
                 pa.array([_joined(s) for s in spans], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, identifiers: str | None = None) -> DataFrame:
    """Counts and spans of the secrets in each row of ``docs`` (``doc_id``, ``text``).

    ``identifiers`` are the dictionary's words; without them they are learned from ``docs``.
    """
    known = common_identifiers(docs) if identifiers is None else identifiers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scanner(known), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
