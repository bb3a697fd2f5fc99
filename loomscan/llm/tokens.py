"""Token counts (operator 2) and token-ID output (operator 9)."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AtomicFile, begin, file_count, freed, open_fs, partitions, scratch, ship, table

SLICE = 512  # rows turned into Python objects at once
CACHE = 300_000  # words whose counts a worker keeps
UNITS = 300_000  # units whose ids a worker keeps, twice at most
LONG_UNIT = 64  # longer units aren't cached

_tokenizers: dict[str, object] = {}
_counts: dict[str, dict[bytes, int]] = {}
_ids: dict[str, Units | None] = {}


def load_tokenizer(name: str):
    """A tokenizer of the tokenizers library, loaded once per process, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _tokenizers[name] = t
    return _tokenizers[name]


def _forget() -> None:
    _counts.clear()
    _ids.clear()


# --- operator 2: overlap resynchronisation -----------------------------------------------------------------------


def drops_space(tok) -> bool:
    """Whether white space surely parts what a tokenizer encodes and is dropped: by the kinds of its steps."""
    steps = json.loads(tok.to_str())
    first, norm = steps["pre_tokenizer"] or {}, steps["normalizer"] or {"type": "Sequence", "normalizers": []}
    if first.get("type") == "Sequence":
        first = first["pretokenizers"][0]
    for n in norm["normalizers"] if norm["type"] == "Sequence" else [norm]:
        if n["type"] not in ("NFC", "NFKC", "Lowercase") and (n["type"], n.get("pattern"), n.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    if first.get("type") == "Split":
        pattern = first["pattern"].get("Regex", "\\s")
        return first["behavior"] == "Removed" and first["invert"] and not any(regex.search(pattern, c) for c in " \t\n\r\x0b\x0c")
    return first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


def _stable(text: str, p: int) -> bool:
    """A word starts at p behind ASCII white space.

    Neither the normaliser nor the pre-tokenizer of a tokenizer that drops white space looks across such a place, and
    merges stay inside pre-tokens, so what is encoded on one side doesn't depend on the other.
    """
    return text[p - 1] in " \t\n\r\x0b\x0c" and not text[p].isspace()


def _common(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], lo: int, hi: int) -> int | None:
    """The first stable boundary in (lo, hi) at which both encodings start a token and then agree up to the next one."""
    firsts = []
    for tokens in (left, right):
        at: dict[int, int] = {}
        for k, (s, _) in enumerate(tokens):
            if lo < s < hi and s not in at and _stable(text, s):
                at[s] = k
        firsts.append(at)
    shared = sorted(firsts[0].keys() & firsts[1].keys())
    for p, q in zip(shared, shared[1:]):
        if left[firsts[0][p] : firsts[0][q]] == right[firsts[1][p] : firsts[1][q]]:
            return p
    return None


def encode_spliced(tok, text: str, chunk: int = 32_768, overlap: int = 512) -> list[int]:
    """Token ids of a text encoded in overlapping chunks and spliced where both encodings provably agree.

    When an overlap has no stable common boundary it is widened, doubling each time, at last to the end of the text;
    so the ids are always those of the whole text. For tokenizers that drop white space (see _stable).
    """

    def encode(a: int, b: int) -> list[tuple[int, int]]:
        e = tok.encode(text[a:b], add_special_tokens=False)
        return [(a + o[0], i) for o, i in zip(e.offsets, e.ids)]

    n, out = len(text), []
    a, b, cut = 0, min(len(text), chunk + overlap), 0  # left encodes [a, b); its tokens before cut are out already
    left = encode(a, b)
    while b < n:
        wide, p = overlap, None
        while b < n:
            s = max(a + 1, b - wide)
            e = min(n, max(b + 1, s + chunk + wide))
            right = encode(s, e)
            if (p := _common(text, left, right, max(s, cut), b)) is not None:
                break
            wide *= 2
            b = min(n, b + wide)
            left = encode(a, b)
        if p is None:
            break
        out += [t for at, t in left if cut <= at < p]
        a, b, cut, left = s, e, p, right
    return out + [t for at, t in left if at >= cut]


def _slices(batch: pa.RecordBatch, *names: str) -> Iterator[list[list]]:
    for k in range(0, batch.num_rows, SLICE):
        part = batch.slice(k, SLICE)
        yield [part.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def token_counter(tokenizer: str, chunk: int, overlap: int):
    """A function from texts to token counts. Words between ASCII white space are counted once and cached.

    For tokenizers to which white space matters, each text is encoded whole.
    """
    tok, cache = load_tokenizer(tokenizer), _counts.setdefault(tokenizer, {})
    if not drops_space(tok):
        return lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]

    def count(texts: list[str]) -> list[int]:
        if len(cache) > CACHE:
            cache.clear()
        words = [t.encode().split() if len(t) <= chunk else [] for t in texts]
        missing = list({w for ws in words for w in ws if w not in cache})
        for k in range(0, len(missing), 4096):
            some = missing[k : k + 4096]
            for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                cache[w] = len(e.ids)
        out = [sum(map(cache.__getitem__, ws)) if len(t) <= chunk else len(encode_spliced(tok, t, chunk, overlap)) for t, ws in zip(texts, words)]
        for w in missing:
            if len(w) > LONG_UNIT:
                del cache[w]
        return out

    return count


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """Exact token counts of whole texts: id, n_bytes, n_tokens, over_limit, n_chars.

    With a tokenizer that drops white space, as word_bpe_49k.json does, texts of up to `chunk` characters are counted by
    words, longer ones in overlapping chunks that are spliced (encode_spliced); with others, texts are encoded whole. One pass, no shuffle. Null texts count
    as empty (0 tokens); rows repeat as they do in the input; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches):
        begin("tokens", _forget)
        count = token_counter(tokenizer, chunk, overlap)
        for batch in freed(batches):
            for ids, texts in _slices(batch, "id", "text"):
                texts = [t or "" for t in texts]
                tokens = count(texts)
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([t > limit for t in tokens], pa.bool_()), "n_chars": pa.array(map(len, texts), pa.int64())}
                )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean, n_chars long")
    return out.withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


# --- operator 9: token-ID stream files ---------------------------------------------------------------------------

#: Blanks with the letters behind them, else blanks with all up to the next blank. With the byte-level pattern a pre-token
#: ends where letters end, if no other letter or digit follows, and where white space follows something else; what comes
#: after is split without a look back. So such units can be encoded one by one.
_UNIT = re.compile(r"[ \t\n\r\x0b\x0c]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?!\w)|[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+\Z")
#: Pre-tokens of the byte-level pattern in units of ASCII and Latin letters. Each goes to the merges on its own, so new
#: units are joined from them.
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+|\s+(?!\S)|\s+", re.A)
#: White space for which the libraries may differ; texts that have it are encoded whole.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


def by_bytes(tok) -> bool:
    """Whether a tokenizer is one whose pre-tokens are those of the byte-level pattern, without a normaliser."""
    return tok.normalizer is None and json.loads(tok.to_str())["pre_tokenizer"] in [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": x, "use_regex": True} for x in (True, False)]


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


class Units(dict):
    """Ids of units as little-endian unsigned 32-bit bytes, found when they are first asked for; two generations of them."""

    def __init__(self, tok):
        self.tok, self.model, self.letters, self.old = tok, tok.model, byte_letters(), {}

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.old.get(unit)) is None:
            ids = self._ids(unit)
            if len(unit) > LONG_UNIT:
                return ids
        self[unit] = ids
        return ids

    def _ids(self, unit: str) -> bytes:
        if "<|" in unit or not _PLAIN.fullmatch(unit):
            return _pack(self.tok.encode(unit, add_special_tokens=False).ids)
        if len(pieces := _PIECE.findall(unit)) > 1:
            return b"".join(map(self.__getitem__, pieces))
        return _pack([t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))])

    def age(self) -> None:
        if len(self) > UNITS:
            self.old = dict(self)
            self.clear()


def id_encoder(tokenizer: str):
    """A function from texts to their ids as little-endian unsigned 32-bit bytes.

    For byte-level tokenizers, ids of units are cached in the worker; for others each text is encoded as it is.
    """
    tok = load_tokenizer(tokenizer)
    if tokenizer not in _ids:
        _ids[tokenizer] = Units(tok) if by_bytes(tok) else None
    known = _ids[tokenizer]

    def encode(texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if known is None or _ODD.search(t):
                yield _pack(tok.encode(t, add_special_tokens=False).ids)
            else:
                yield b"".join(map(known.__getitem__, _UNIT.findall(t)))
                known.age()

    return encode


class StreamFile:
    """Writes ids to an Arrow file of fixed-size lists: seq_len ids and seq_len mask bits a row.

    The last row is padded with `pad`, its mask is 0 there. All batches but the last have batch_rows rows and the format
    has a footer, so any sequence can be mapped and read without a copy (SequenceFile). A second file `.docs.arrow` has
    id, offset and n_tokens of each document in the stream.
    """

    def __init__(self, uri: str, seq_len: int, wide: bool, pad: int = 0, batch_rows: int = 256):
        self.kind = pa.uint32() if wide else pa.uint16()
        self.dtype, self.seq_len, self.pad, self.batch_rows = ("<u4" if wide else "<u2"), seq_len, pad, batch_rows
        self.files = [AtomicFile(uri), AtomicFile(f"{uri}.docs.arrow")]
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], {"seq_len": str(seq_len), "batch_rows": str(batch_rows)})
        self.docs_schema = pa.schema([("id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.writer = pa.ipc.new_file(self.files[0].out, self.schema)
        self.docs_writer = pa.ipc.new_file(self.files[1].out, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held, self.n_ids, self.docs = 0, 0, ([], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, x in zip(self.docs, (doc_id, self.n_ids, len(ids))):
            column.append(x)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.seq_len * self.batch_rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        rows = -(-len(ids) // self.seq_len) if last else len(ids) // (self.seq_len * self.batch_rows) * self.batch_rows
        size = rows * self.seq_len
        self.held = [] if last else [ids[size:]]
        mask = np.ones(size, bool)
        if size > len(ids):
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.full(size - len(ids), self.pad, self.dtype)])
        self.n_held = 0 if last else len(self.held[0])
        for k in range(0, rows, self.batch_rows):
            a, b = k * self.seq_len, min(rows, k + self.batch_rows) * self.seq_len
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x[a:b], t), self.seq_len) for x, t in ((ids, self.kind), (mask, pa.bool_()))], schema=self.schema))
        if self.docs[0]:
            self.docs_writer.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.docs], schema=self.docs_schema))
            self.docs = ([], [], [])

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.docs_writer.close()
        for f in reversed(self.files):
            f.commit()


def _opened(uri: str) -> pa.NativeFile:
    """An Arrow file, mapped into memory where it is local."""
    fs, path = open_fs(uri)
    return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)


class SequenceFile:
    """Random access to the sequences of a stream file; on local files without a copy: arrays are views of the mapping."""

    def __init__(self, uri: str):
        self.file = _opened(uri)
        self.reader = pa.ipc.open_file(self.file)
        self.seq_len, self.batch_rows = (int(self.reader.schema.metadata[k]) for k in (b"seq_len", b"batch_rows"))
        batches = self.reader.num_record_batches
        self.rows = (batches - 1) * self.batch_rows + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.rows

    def __enter__(self) -> SequenceFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence k; the mask is bits, so it stays an Arrow array."""
        if not 0 <= k < self.rows:
            raise IndexError(k)
        batch, at = self.reader.get_batch(k // self.batch_rows), k % self.batch_rows * self.seq_len
        ids, mask = (batch.column(c).values.slice(at, self.seq_len) for c in (0, 1))
        return ids.to_numpy(), mask


def read_ids(uri: str) -> Iterator[np.ndarray]:
    """Ids of each batch of a stream file, with the padding, as flat arrays."""
    with _opened(uri) as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k).column(0).values.to_numpy()


def read_documents(uri: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(id, offset in the file's stream, n_tokens, crc32 of the ids) of each document, from the file's sequences."""
    ids = (x.astype("<u4") for x in read_ids(uri))
    now, at = np.empty(0, "<u4"), 0
    with _opened(f"{uri}.docs.arrow") as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            for d, offset, n in zip(*(c.to_pylist() for c in reader.get_batch(k).columns)):
                crc, left = 0, n
                while left:
                    if at == len(now):
                        now, at = next(ids), 0
                    some = now[at : at + left]
                    crc, left, at = zlib.crc32(some.tobytes(), crc), left - len(some), at + len(some)
                yield d, offset, n, crc


def stored_order(docs: DataFrame) -> list[Column]:
    """Columns that order a table of part files as it was written, by number, path and row; none where docs isn't read from files."""
    try:
        meta = docs.metadataColumn("_metadata")
        order = [F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).try_cast("long"), meta["file_path"], meta["row_index"]]
        docs.select(*order).schema
        return order
    except AnalysisException:
        return []


def is_scan(docs: DataFrame) -> bool:
    """Whether docs only reads files, perhaps with columns and rows left out, so that its tasks have a split's rows as they are stored."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def write_token_stream(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, seq_len: int = 1024, order: list[Column] | None = None, stored: bool = False) -> DataFrame:
    """Encode whole texts, append end_id to each, and write all ids in ascending order of id; returns the files.

    Documents are dealt by ranges, so file k holds the k-th range and the concatenated files are one stream in order;
    there is a file for 32 MB of the table. Result: part, uri, n_docs, n_ids, and start (ids in the files before). Null
    ids come first, null texts are empty (just the end id), rows with equal ids are ordered by a hash of the text. With
    `order`, the stream follows these columns of docs instead. An empty table gives no rows.

    With `stored`, it follows stored_order(docs) where docs is read from files, and `order` is ignored then. Nothing is
    shuffled if docs is just that: each split that a task reads is a stretch of the order and becomes a file of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    if places := stored_order(docs) if stored else []:
        order = places
    in_place = bool(places) and is_scan(docs)

    def run(batches):
        begin("tokens", _forget)
        encode, end, out, now, n = id_encoder(tokenizer), np.asarray([end_id], "<u4").tobytes(), None, None, 0
        wide = load_tokenizer(tokenizer).get_vocab_size() > 65_536 or end_id > 65_535
        task = TaskContext.get().partitionId()

        def close():
            out.close()
            number, path, _, first = now
            return pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "path": [path], "first": pa.array([first], pa.int64()), "uri": [uri], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

        for batch in freed(batches):
            for ids, texts, *splits in _slices(batch, "id", "text", *(("number", "path", "split", "first") if in_place else ())):
                at = zip(*splits) if in_place else repeat((task, "", 0, 0))
                for d, packed, split in zip(ids, encode([t or "" for t in texts]), at):
                    if now is None or split[:3] != now[:3]:
                        if out:
                            yield close()
                        now, n = split, 0
                        uri = f"{folder}/part-{split[0] or 0:06d}{f'-{md5(split[1].encode()).hexdigest()}-{split[3]:012d}' if in_place else ''}.arrow"
                        out = StreamFile(uri, seq_len, wide)
                    out.add(d, np.frombuffer(packed + end, "<u4"))
                    n += 1
        if out:
            yield close()

    rows = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
    if in_place:
        number, path, row = places
        rows = docs.select(*rows, number.alias("number"), path.alias("path"), docs.metadataColumn("_metadata")["file_block_start"].alias("split"), row.alias("first"))
    else:
        order = order or [F.col(id_col).cast("long")]
        names = [f"o{k}" for k in range(len(order))]
        rows = docs.select(*rows, *[c.alias(n) for c, n in zip(order, names)])
        rows = rows.repartitionByRange(file_count(docs), *names).sortWithinPartitions(*names, "id", F.xxhash64("text")).select("id", "text")
    files = rows.mapInArrow(run, "number long, path string, first long, uri string, n_docs long, n_ids long")
    files.write.parquet(manifest := f"{folder}/manifest")
    files = spark.read.schema(files.schema).parquet(manifest)  # one row a file
    by_place = Window.orderBy("number", "path", "first")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    part = F.row_number().over(by_place) - 1 if in_place else F.col("number").cast("int")
    return files.select(part.alias("part"), "uri", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_token_stream(files: DataFrame) -> DataFrame:
    """One row per document read back from the files of write_token_stream: id, start, n_tokens, ids_crc32, part."""

    def run(batches):
        for batch in batches:
            for part, uri, start in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "uri", "start"))):
                rows: list[tuple] = []
                for d, offset, n, crc in read_documents(uri):
                    rows.append((d, start + offset, n, crc, part))
                    if len(rows) == 8192:
                        yield _stream_rows(rows)
                        rows = []
                if rows:
                    yield _stream_rows(rows)

    spark = files.sparkSession
    return files.repartition(partitions(spark), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def _stream_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "part")
    return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int32() if n == "part" else pa.int64()) for n, x in zip(names, zip(*rows))})


def token_stream(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Write documents as a token stream in shared storage and read it back, one row per document."""
    return read_token_stream(write_token_stream(docs, scratch(docs.sparkSession, "tokens"), stored=stored))


def op9_token_stream_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts, "op9_token_stream_file": op9_token_stream_file}
ORACLES: dict[str, str] = {}
