"""Each stage of the pipeline on what the one before kept, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from loomscan.llm.decontaminate import budget, normal
from loomscan.llm.quality import judge_quality
from loomscan.llm.tokens import load_tokenizer

from helpers import SMALL
from test_neardup import brute
from test_operators import fewest_edits


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents and the result of each stage, written as Parquet and read again."""
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for name, f in P.STAGES:
        f(spark, out[-1], SMALL).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text").collect())


def test_columns(steps):
    assert all(sorted(s.columns) == sorted(steps[0].columns) for s in steps[1:-1])


def test_quality(steps):
    bad = {r["doc_id"] for r in judge_quality(steps[0]).filter("not kept").collect()}
    assert rows(steps[1]) == Counter({r: n for r, n in rows(steps[0]).items() if r[0] not in bad}) and bad


def test_near_dedup(steps):
    keep = {i for i, _, c in brute(list(rows(steps[1])), 5, 80) if i == c}
    assert rows(steps[2]) == Counter({r: n for r, n in rows(steps[1]).items() if r[0] in keep}) and len(keep) < len(rows(steps[1]))


def test_decontamination(spark, steps):
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = rows(steps[2]), rows(steps[3])
    assert not after - before
    for i, t in before - after:
        assert any(fewest_edits(x, normal(t)) <= budget(len(x)) for x in items)
    assert not any(x in normal(t) for _, t in after for x in items if len(x) >= 12)


def test_mixing(steps):
    before, after = rows(steps[3]), rows(steps[4])
    size = sum(len((t or "").encode().split()) * n for (_, t), n in before.items())
    taken = sum(len((t or "").encode().split()) * n for (_, t), n in after.items())
    assert all(n <= 2 * before[r] for r, n in after.items())
    assert 1.4 * size < taken <= 1.5 * size


def test_token_output(steps):
    """The stream has the mix's order, which is that of its files and of the rows in them."""
    tok = load_tokenizer("byte_bpe_50k.json")
    at, wanted = 0, []
    stored = steps[4].select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r["doc_id"] for r in stored] != sorted(r["doc_id"] for r in stored)
    for r in stored:
        x = np.asarray([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((r["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    wanted.sort()
    assert sorted(tuple(r) for r in steps[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == wanted


def test_run_gives_the_stages_result(spark, steps):
    assert sorted(tuple(r) for r in P.run(spark, SMALL).drop("part").collect()) == sorted(tuple(r) for r in steps[5].drop("part").collect())
