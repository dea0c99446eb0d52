"""Secrets: fixed patterns, and strings that a public vocabulary cannot compress.

A run of code-like characters is *exposed* when its characters per token are few: natural words are single
tokens of several characters, random strings fall apart into tokens of one or two. Digests of a known length,
UUIDs, numbers and other identifiers fall apart too, so they are excluded first. A run that passes as a whole,
like a path, is tested part by part. Parts of letters without a change of case are words unless they
fall apart further than long words of any language do.

Defined results: a null text is an empty one; an empty text has no spans; equal rows give equal results; an
empty table gives an empty one. Texts are searched whole.
"""

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_batch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public split pattern of that vocabulary family.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KINDS = ("assign", "access", "hex", "token")

# Patterns of the contract. A run of one character class is taken whole, so a least length can be part of
# the pattern for `access` and `hex`; for `assign` a short value still uses up its text.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
# Not secrets in themselves: digests of the usual lengths, UUIDs, numbers.
KNOWN = re.compile(r"""(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}
    |[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}
    |[0-9+/_=-]+)""", re.VERBOSE)
# Plain or snake-cased words, paths: never secrets as a whole.
WORDS = re.compile(r"""[/_=+-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_=+-]*""")
MAX_RATIO = 2.2
# For letters without digits and without changes of case, as a share of the ratio for others.
WORD_SHARE = 0.85


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` of the fixed patterns, ordered by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def exposed_spans(text: str, vocabulary: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """Code-like runs with at most `max_ratio` characters to a token, or their parts; known identifiers left out."""
    def exposed(run: str, ratio: float) -> bool:
        return len(run) <= ratio * len(encoding(vocabulary).encode_ordinary(run))

    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if KNOWN.fullmatch(run):
            continue
        if coded(run) and not WORDS.fullmatch(run) and exposed(run, max_ratio):
            found.append((m.start(), 3, m.end()))
            continue
        for part in PART.finditer(run):
            piece = part.group()
            if KNOWN.fullmatch(piece) or len(piece) == len(run) and coded(run) and not WORDS.fullmatch(run):
                continue
            if exposed(piece, max_ratio if coded(piece) else WORD_SHARE * max_ratio):
                found.append((m.start() + part.start(), 3, m.start() + part.end()))
    return found


def coded(run: str) -> bool:
    """Whether a run has digits, or changes of case as words do not have."""
    return any(c.isdigit() for c in run) or mixed_case(run)


def mixed_case(run: str) -> bool:
    """Whether letter case changes inside words again and again, as in random letters."""
    changes = sum(a.islower() != b.islower() for a, b in zip(run, run[1:]) if a.isalpha() and b.isalpha())
    return changes >= len(run) // 5


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """`text` with each maximal covered stretch replaced by `mark`."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                 vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """`id, base array<struct<kind,start,end>>, spans array<…>`: one row per document, code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, every = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            fixed = base_spans(text)
            base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in fixed])
            found = sorted(fixed + exposed_spans(text, vocabulary, max_ratio))
            every.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)],
                                         names=[id_column, "base", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return by_batch(docs.select(id_column, text_column), scan, f"`{id_column}` {kind}, base {spans}, spans {spans}")


def redact_secrets(docs: DataFrame, text_column: str = "text", *, mark: str = "<secret>",
                   vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """`docs` with every found secret replaced by `mark`; a null text stays null, other columns as they are."""
    names = docs.columns
    at = names.index(text_column)

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if t is None else redacted(t, sorted(base_spans(t) + exposed_spans(t, vocabulary, max_ratio)), mark)
                 for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return by_batch(docs, clean, docs.schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's row per document, made from the spans of `find_secrets`."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(id_column, count("assign"), count("access"), count("hex"),
                        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
