"""Secret scans (operator 5): base patterns, and Zstandard novelty of strings in sensitive contexts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log2
from string import ascii_letters, digits

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

_ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what stands within REACH characters sensitive.
_CONTEXT = re.compile(r"(?i:passw|secret|token|api[\s_-]?key|access[\s_-]?key|private[\s_-]?key|credential|auth|bearer|signature|client[\s_-]?id|connection[\s_-]?string|salt|nonce|session)", re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{16,}", re.A)
_EDGES = "+/_.=~!@#$%^&*-"
_CHARACTERS = frozenset(ascii_letters + digits + _EDGES)
_SENTENCE = re.compile(r"[.!?]\s")
#: The body of a private key: up to 16 header lines are passed, lines may be broken as in JSON or in concatenated strings.
_BREAK = r"(?:\s\+\s|[\s\"',]|\\[nrt])"
_PEM = re.compile(rf"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----{_BREAK}*+(?:[A-Z][A-Za-z-]{{0,40}}+: [^\n\\]{{0,200}}+{_BREAK}++){{0,16}}+([A-Za-z0-9+/=]{{16,}}+(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+)*+(?:{_BREAK}++[A-Za-z0-9+/=]++(?={_BREAK}*+-----END))?)")
_BETWEEN = re.compile(_BREAK)
_OTHER, _LETTERS, _DIGIT, _LOWER, _UPPER = (re.compile(p) for p in ("[^A-Za-z0-9]+", "[A-Za-z]+", "[0-9]", "[a-z]", "[A-Z]"))
_ALPHABETS = [(n, re.compile(p)) for n, p in ((10, "[0-9]+"), (16, "[0-9a-f]+|[0-9A-F]+"), (26, "[a-z]+|[A-Z]+"), (36, "[a-z0-9]+|[A-Z0-9]+"))]
CODED = 57
REACH, AROUND, MIN_RATIO, SHORTEST = 80, 512, 0.7, 16

#: The identifier dictionary: what code and prose around secrets is made of, so that it costs next to nothing.
IDENTIFIERS = " ".join(
    """abstract account address algorithm application argument array assert async attribute authenticate authorization await base64
    boolean buffer byte callback catch certificate character class client collection column command common component config
    configuration connection console const constructor container content context continue controller copyright count create
    credential current database datetime default define delete description destination dictionary directory document double element
    encoding encrypt endpoint environment error event example exception execute export extends false field filename finally float
    foreach format function generate global handler hash header hostname http https identifier implements import include index
    initialize input insert instance integer interface internal iterator keyboard keyword lambda language length license list
    localhost location logger manager message metadata method middleware module namespace navigation network null number object
    operation operator option output override package parameter parse password path pattern permission placeholder platform pointer
    port position prefix primary print private process project property protected protocol provider proxy public query random read
    reference register release remote replace repository request require resource response result return runtime sample schema script
    secret section security select sequence server service session settings signature source split standard start state static status
    stream string struct subject suffix switch synchronized system table target template temporary test thread throw timeout
    timestamp token transaction transform true type undefined unicode update upload url user username utility validate value variable
    vector version void volatile warning while window workspace wrapper write www xml yaml your_api_key_here changeme example_token
    xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ .com .org .net .html .json""".split()
).encode()
_PAIRS = {w[k : k + 2] for w in re.findall("[a-z]+", IDENTIFIERS.decode().split(" your_api")[0]) for k in range(len(w) - 1)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its own bytes.

    The compressor is primed with the identifier dictionary and the text around the candidate.
    """
    around = (before + "\n" + after).encode("utf-8", "replace")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False).compress
    tail = before[-32:].encode("utf-8", "replace")
    data = candidate.encode()
    return (len(compress(tail + data)) - len(compress(tail))) / len(data)


def candidates(text: str) -> list[tuple[int, int]]:
    """What may be secret, by place: bodies of private keys, and strings of 16 characters or more near a sensitive word.

    Near is within REACH characters before or after the word, over line feeds too; a sentence's end parts a word from
    what stands before it. Runs of candidate characters are found once and met with the sensitive words in order, so
    work grows with the text's length; a word inside a run ends the candidate before it.
    """
    words = [m.span() for m in _CONTEXT.finditer(text)]
    keys = [m.span(1) for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else []
    starts = [a for a, _ in keys]
    runs = [m.span() for m in _CANDIDATE.finditer(text)] if words else []
    ends = [b for _, b in runs]
    out: list[tuple[int, int]] = []
    done = 0

    def take(a: int, b: int) -> None:
        nonlocal done
        done = b
        k = bisect_right(starts, b - 1)
        if not k or keys[k - 1][1] <= a:
            out.append((a, b))

    for start, end in words:
        low = max(done, start - REACH)
        k = bisect_right(ends, low)
        if k < len(runs) and runs[k][0] < low:
            low = max(done, runs[k][0])
        while k < len(runs) and runs[k][0] < start:
            a, b = max(low, runs[k][0]), min(start, runs[k][1])
            if b - a >= SHORTEST and not _SENTENCE.search(text, b - 1, start):
                take(a, b)
            k += 1
        at = max(done, end)
        k = bisect_right(ends, at)
        while k < len(runs) and max(at, runs[k][0]) < end + REACH:
            if runs[k][1] - max(at, runs[k][0]) >= SHORTEST:
                take(max(at, runs[k][0]), runs[k][1])
            k += 1
    return sorted(out + keys)


def surroundings(text: str, spans: list[tuple[int, int]], k: int) -> tuple[str, str]:
    """AROUND characters before and after candidate k, without the other candidates that hold the same string.

    Copies would make each other cheap, and a secret that is used twice would be lost. "=X" and "X&y=1" hold X too.
    """
    a, b = spans[k]
    own = text[a:b].strip(_EDGES)
    low, high, copies = max(0, a - AROUND), min(len(text), b + AROUND), []
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(spans) and spans[j][1] > low and spans[j][0] < high:
            other = text[spans[j][0] : spans[j][1]].strip(_EDGES)
            if own and other and (own in other or other in own):
                copies.append(spans[j])
            j += step

    def cleared(at: int, end: int) -> str:
        parts = []
        for x, y in sorted(copies):
            if x < end and y > at:
                parts.append(text[at : max(at, x)])
                at = min(y, end)
        return "".join([*parts, text[at:end]])

    return cleared(low, a), cleared(b, high)


def is_novel(s: str, ratio: float) -> bool:
    """Whether so many compressed bytes a byte are as many as a random string of the same characters costs.

    The compressor codes characters by their frequency in strings of CODED or more, so there the limit goes down with
    the size of the smallest usual alphabet that has the string's letters and digits. Strings that pass by that alone,
    or lack two of digit, lower and upper case, mustn't look like words.
    """
    plain = _OTHER.sub("", s)
    mixed = sum(map(bool, (_DIGIT.search(plain), _LOWER.search(plain), _UPPER.search(plain)))) >= 2
    if mixed and ratio >= MIN_RATIO:
        return True
    size = next((n for n, of in _ALPHABETS if of.fullmatch(plain)), 64)
    return ratio >= (min(MIN_RATIO, MIN_RATIO / 6 * log2(size)) if len(s) >= CODED else MIN_RATIO) and not wordy(plain)


def wordy(s: str) -> bool:
    """Whether a string is mostly letters and three quarters of their pairs are pairs of the identifier dictionary."""
    runs = _LETTERS.findall(s)
    pairs = [r[k : k + 2].lower() for r in runs for k in range(len(r) - 1)]
    return 4 * sum(map(len, runs)) > 3 * len(s) and 4 * sum(p in _PAIRS for p in pairs) >= 3 * len(pairs)


def novel_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that are incompressible; copies of a candidate are judged each without the others."""
    out: list[tuple[int, int, str]] = []
    spans = candidates(text)
    for k, (a, b) in enumerate(spans):
        s = _BETWEEN.sub("", text[a:b])
        before, after = surroundings(text, spans, k)
        if is_novel(s, novelty(before, s, after)):
            out.append((a, b, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of whole texts: id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Spans are kind:start:end in code points, end exclusive, by start and kind. Kind novel is the method's: the body of a
    private key, or a string in a sensitive context (candidates() says which), which costs a compressor, primed with an
    identifier dictionary and the text around it, 0.7 bytes or more a byte, less for long strings of few different
    characters (is_novel()). Other candidates that hold the same string are no part of that text; a copy where nothing
    is sensitive is. One pass, no shuffle; work in a text grows with its length and the number of candidates. Null texts are empty; rows repeat as in
    the input; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    kinds = [("id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())]

    def row(text: str) -> tuple:
        base, more = base_spans(text), novel_spans(text)
        n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                ids, texts = (c.to_pylist() for c in batch.slice(k, 512).columns)
                columns = [ids, *zip(*(row(t or "") for t in texts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
    return out.withColumnRenamed("id", id_col)


def op5_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_novelty": op5_secret_novelty}
ORACLES: dict[str, str] = {}
