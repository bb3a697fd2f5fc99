import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomscan.llm.common import open_fs
from loomscan.llm.tokens import SequenceFile, StreamFile, count_tokens, drops_space, encode_spliced, id_encoder, load_tokenizer, op2_token_counts, op9_token_stream_file, read_token_stream, token_counter, write_token_stream

from helpers import SMALL

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
PIECES = ["the", "quick", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "it's", "'tis", "x1", "42nd", "1234567", "é", "naïve", "é", "日本語", "𝒳", " ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "...", "!?", "-", "_", "A_b", "ﬁ", "İ", "​", "ß", "'", "'S", "'re", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\0"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


def ids(name, text):
    return load_tokenizer(name).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_counts_by_words(texts):
    assert token_counter(WORDS, 1 << 20, 512)(texts) == [len(ids(WORDS, t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(8, 60), st.integers(1, 16))
def test_spliced_chunks(text, chunk, overlap):
    assert encode_spliced(load_tokenizer(WORDS), text, chunk, overlap) == ids(WORDS, text)


def test_overlaps_widen_where_no_boundary_is():
    text = "x" * 500 + " y " + "ab" * 400 + " the end of it all " * 30
    assert encode_spliced(load_tokenizer(WORDS), text, 64, 4) == ids(WORDS, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_ids_by_units(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in id_encoder(BYTES)(texts)] == [ids(BYTES, t) for t in texts]


def test_token_counts_of_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    got = op2_token_counts(spark, SMALL).toPandas().set_index("doc_id")
    for d in docs.itertuples():
        n = len(ids(WORDS, d.text or ""))
        assert got.loc[d.doc_id, ["n_bytes", "n_tokens", "over_limit"]].tolist() == [len((d.text or "").encode()), n, n > 2048]


def test_small_chunks_give_the_same_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = (sorted(map(tuple, count_tokens(docs, chunk=c, overlap=o).collect())) for c, o in ((32_768, 512), (300, 20)))
    assert a == b


def test_stream_of_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    got = {r["doc_id"]: r for r in op9_token_stream_file(spark, SMALL).collect()}
    at = 0
    for d in docs.itertuples():
        x = np.asarray([*ids(BYTES, d.text or ""), 2], "<u4")
        r = got.pop(d.doc_id)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert not got


@pytest.mark.parametrize("seq_len", [7, 64])
def test_files_hold_equal_sequences(spark, make_docs, tmp_path, seq_len):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(0, 50)))) for k in range(40)] + [(40, None)]
    files = write_token_stream(make_docs(rows), f"file://{tmp_path}/s", seq_len=seq_len)
    parts = files.orderBy("part").collect()
    stream = []
    for p in parts:
        fs, path = open_fs(p["uri"])
        with pa.memory_map(path) as source:
            table = pa.ipc.open_file(source).read_all()
        assert pa.types.is_fixed_size_list(table.schema.field("ids").type) and table.schema.field("ids").type.list_size == seq_len
        assert len(stream) == p["start"]
        flat, mask = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks]) for n in ("ids", "mask"))
        stream += flat[mask].tolist()
        assert (~mask).sum() < seq_len
    assert stream == [i for _, t in rows for i in [*ids(BYTES, t or ""), 2]]
    back = read_token_stream(files).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in back] == list(range(41))


def test_sequences_are_read_at_random_without_a_copy(tmp_path):
    f = StreamFile(f"file://{tmp_path}/x.arrow", 4, False, batch_rows=2)
    for k in range(0, 30, 3):
        f.add(k, np.arange(k, k + 3, dtype="<u4"))
    f.close()
    with SequenceFile(f"file://{tmp_path}/x.arrow") as got:
        before = pa.total_allocated_bytes()
        assert len(got) == 8
        for k in (7, 0, 5, 3):
            ids, mask = got[k]
            assert ids.tolist() == [x if x < 30 else 0 for x in range(4 * k, 4 * k + 4)] and not ids.flags.owndata
            assert mask.to_pylist() == [x < 30 for x in range(4 * k, 4 * k + 4)]
        assert pa.total_allocated_bytes() - before < 4096
        with pytest.raises(IndexError):
            got[8]
        del ids, mask


def test_tokenizers_that_keep_white_space_count_whole_texts():
    assert drops_space(load_tokenizer(WORDS)) and not drops_space(load_tokenizer(BYTES))
    texts = ["a  b\n\nc", " x ", "", "one two " * 30]
    assert token_counter(BYTES, 8, 2)(texts) == [len(ids(BYTES, t)) for t in texts]


def test_stream_follows_an_order(spark, make_docs, tmp_path):
    docs = make_docs([(k, "w " * (k % 5)) for k in range(50)])
    files = write_token_stream(docs, f"file://{tmp_path}/o", order=[F.col("doc_id") % 7, -F.col("doc_id")])
    back = read_token_stream(files).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted(range(50), key=lambda k: (k % 7, -k))


def test_stored_stream_is_written_in_place(spark, make_docs, tmp_path):
    """Files of a table, in several splits and some without a number, become the stream in their order; texts aren't shuffled."""
    docs = make_docs([(97 * k % 400, f"w{k} " * (k % 90)) for k in range(400)])
    docs.repartitionByRange(3, F.col("doc_id") % 7).write.option("parquet.block.size", 4096).option("compression", "none").parquet(f"{tmp_path}/d")
    docs.limit(5).coalesce(1).write.parquet(f"{tmp_path}/e")
    name = next((tmp_path / "e").glob("part-*.parquet")).rename(tmp_path / "d" / "other.parquet")
    stored = spark.read.parquet(f"{tmp_path}/d")
    wanted = [r["doc_id"] for r in stored.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy(F.col("file_name") != name.name, "file_name", "row_index").collect()]
    assert len(wanted) == 405
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for docs, in_place in ((stored, True), (stored.hint("rebalance"), False)):
            files = write_token_stream(docs, f"file://{tmp_path}/s{in_place}", stored=True)
            parts = files.orderBy("part").collect()
            back = read_token_stream(files).orderBy("start").collect()
            assert [r["doc_id"] for r in back] == wanted and {r["part"] for r in back} == {p["part"] for p in parts}
            assert [p["start"] for p in parts] == [sum(p["n_ids"] for p in parts[:k]) for k in range(len(parts))]
            assert sum(p["n_docs"] for p in parts) == 405
            assert not in_place or [p["part"] for p in parts] == list(range(len(parts))) and len(parts) > 4 and all(len(p["uri"].rsplit("-", 2)[-2]) == 32 for p in parts)
            texts = dict(docs.select("doc_id", F.coalesce("text", F.lit(""))).collect())
            at = 0
            for r in back:
                x = np.asarray([*ids(BYTES, texts[r["doc_id"]]), 2], "<u4")
                assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
                at += len(x)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read_token_stream(write_token_stream(stored.limit(0), f"file://{tmp_path}/none", stored=True)).count() == 0
