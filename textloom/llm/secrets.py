r"""Secret scans: fixed patterns, and random strings found by their token efficiency.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a key word, a separator and a value of
12 or more characters), ``access`` (AKIA and 18 or more characters in all), ``hex`` (16 or more of
[0-9a-f]). The method adds ``random``: a run of [A-Za-z0-9+/_=-] that holds a letter, of 12 or more
characters if it holds a digit too and of 20 or more if not (shorter words of prose can be as inefficient), of which a token of the vocabulary covers fewer than MAX_RATIO characters on average, and
that is no known digest (hex of a digest's length), UUID, number or plain identifier: text a
vocabulary has seen merges into long tokens, random strings do not. In an identifier, parts joined by
_ / + = or - are words or camel case with up to 4 digits before and after; its words, without
separators and digits and in small letters where they are all capitals, reach MAX_RATIO together, and
each of LONG_WORD or more letters by itself.

Defined results: a null text is scanned as empty; one output row per input row, repeated rows
included; offsets are code points, ends exclusive; extra columns pass through ``scan`` and
``redact``, columns with the names of its outputs are replaced; an empty table gives an empty result.
Texts are scanned whole, one Arrow batch in memory; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# Greedy runs: a run that is too short stays too short however it is cut, so the bound can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MIN_LETTERS = 20
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
NUMBER = re.compile(r"[0-9/=_+-]+(?:[Te][0-9/=_+-]+)?Z?\Z")
SEPARATORS = re.compile(r"[_/=+-]+")
PART = re.compile(r"[0-9]{0,4}([A-Za-z]+)[0-9]{0,4}\Z")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LONG_WORD = 8
FILLER = 3
MAX_RATIO = 2.1


@lru_cache(maxsize=4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the default tiktoken vocabulary; parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def is_identifier(s: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    letters = tokens = 0
    for part in SEPARATORS.split(s):
        if not part or part.isdigit():
            continue
        m = PART.match(part)
        if not m:
            return False
        for word in WORD.findall(m[1]):
            n = len(encoding.encode_ordinary(word.lower() if word.isupper() else word))
            if len(word) >= LONG_WORD and len(word) < max_ratio * n:
                return False
            letters += len(word)
            tokens += n
    return letters >= max_ratio * tokens


def is_random(s: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    if len(s) < MIN_LETTERS and not re.search("[0-9]", s):
        return False
    if not re.search("[A-Za-z]", s) or DIGEST.match(s) or UUID.match(s) or NUMBER.match(s) or len(set(s)) <= FILLER:
        return False
    return len(s) < max_ratio * len(encoding.encode_ordinary(s)) and not is_identifier(s, encoding, max_ratio)


def spans(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end, kind), sorted."""
    found = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(k in raw for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if is_random(m[0], encoding, max_ratio):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches: Iterator[pa.RecordBatch], text: str, names: list[str], vocab: str, pattern: str, max_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(vocab, pattern)
    for batch in batches:
        counts, shas, joined = ([], [], []), [], []
        for value in batch.column(text):
            found = spans(value.as_py() or "", encoding, max_ratio)
            base = [x for x in found if x[1] < 3]
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(found))
        new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(joined, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *OUTPUTS])


OUTPUTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocab: tuple[str, str] | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The ``keep`` columns of every row with OUTPUTS; all spans as ``kind:start:end``, comma-joined."""
    path, pattern = vocab or vocabulary()
    names = [c for c in keep if c not in OUTPUTS]
    d = docs.select(*dict.fromkeys([*names, text]))
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in OUTPUTS])
    return d.mapInArrow(lambda b: _scan(b, text, names, path, pattern, max_ratio), schema)


def _redact(batches: Iterator[pa.RecordBatch], at: int, vocab: str, pattern: str, max_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(vocab, pattern)
    for batch in batches:
        texts = []
        for value in batch.column(at):
            text = value.as_py()
            if text:
                out, last = [], 0
                for a, k, b in spans(text, encoding, max_ratio):
                    if b > last:  # overlapping spans make one mark, of the first kind
                        if a >= last:
                            out += [text[last:a], f"[{KINDS[k]}]"]
                        last = b
                text = "".join(out) + text[last:]
            texts.append(text)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, text: str = "text", vocab: tuple[str, str] | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with every span of its text column replaced by a mark; texts without one are unchanged."""
    path, pattern = vocab or vocabulary()
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda b: _redact(b, at, path, pattern, max_ratio), docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size(F.filter(F.split("spans", ","), lambda x: x != "")).cast("long"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE_SQL: dict[str, str] = {}
