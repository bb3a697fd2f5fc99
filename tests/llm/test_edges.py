"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomscan.llm import oracle_sql, queries
from loomscan.llm.decontaminate import contaminated, drop_contaminated
from loomscan.llm.lines import drop_template_lines
from loomscan.llm.mixing import fair_queue_mix, repeat_mixed
from loomscan.llm.neardup import keep_one, near_duplicates
from loomscan.llm.quality import judge_quality, keep_good
from loomscan.llm.secretscan import scan_secrets
from loomscan.llm.tokens import count_tokens, token_stream
from loomscan.llm.urls import judge_urls
from loomscan.llm.warc import read_warc, write_warc

from helpers import ROOT, SMALL

Q, O = queries(), oracle_sql()
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def page_rows():
    big, link = "x" * 1000, '<link rel="canonical" href="{}">'
    return [
        (1, "http://Example.ORG/es/a", big), (2, "https://sub.example.org:443/en/1/x?q#f", big), (3, None, None), (4, "no scheme", ""), (5, "http://a.de/p", link.format("http://b.com/de/x")),
        (6, "http://b.com/de/x", link.format("/de/y")), (7, "http://c.net", link.format("http://a.de/p") + "é" * 1000), (8, "http://d.net/?x", "short"), (9, "http://d.net/?x", "short"),
        (10, "http://e.net/a/b", link.format("c")), (11, "http://e.net/a/c", link.format("http://org/")), (12, "://", None), (13, "http://b.com/de/x", '<meta http-equiv="refresh" content="0; url=http://c.net/">' + big),
        (None, "http://f.net", big), (15, "ftp://user@g.com:80/de/", "é" * 500),
    ]


def copy_of(df, tmp_path, name):
    df.write.parquet(path := f"{tmp_path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(O))
def test_matches_sql_on_the_small_tables(spark, same_rows, name):
    same_rows(Q[name](spark, SMALL), O[name])


@pytest.mark.parametrize("name", ["op1_quality_divergence", "op3_minhash_bbit", "op7_fair_queue_mix", "op10_log_template_lines"])
def test_documents_match_sql_on_edges(spark, make_docs, edge_rows, same_rows, tmp_path, name):
    path = copy_of(make_docs(edge_rows).repartition(3), tmp_path, "documents")
    same_rows(Q[name](spark, str(tmp_path)), O[name], documents=f"{path}/*.parquet")


@pytest.mark.parametrize("name", ["op4_warc_dictionary", "op6_redirect_equivalence"])
def test_pages_match_sql_on_edges(spark, page_rows, same_rows, tmp_path, name):
    path = copy_of(spark.createDataFrame(page_rows, PAGES).repartition(3), tmp_path, "pages")
    same_rows(Q[name](spark, str(tmp_path)), O[name], pages=f"{path}/*.parquet")


ON_DOCS = {
    "quality": judge_quality, "tokens": count_tokens, "near": near_duplicates, "secrets": scan_secrets, "mix": fair_queue_mix, "stream": token_stream, "lines": drop_template_lines,
    "keep_good": keep_good, "keep_one": keep_one, "repeat_mixed": repeat_mixed,
}


def told(df, columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_documents(make_docs, edge_rows, with_clashes, name):
    """Rows with null ids and repeated rows, and columns that clash, change nothing for the others."""
    f = ON_DOCS[name]
    docs = make_docs([*edge_rows, (None, "one", "fr", "s3", 1), (9, "one", "fr", "s3", 1), (None, None, None, None, None)])
    plain = f(docs)
    rows = told(plain, plain.columns)
    if not name.startswith(("keep", "repeat")):
        assert len(rows) == docs.count()
    else:  # rows of the input, each by itself: never one that isn't there, nor more often than allowed
        mine, theirs = Counter(rows), Counter(told(docs, plain.columns))
        assert all(n <= (2 if name == "repeat_mixed" else 1) * theirs[r] for r, n in mine.items())
    assert told(f(with_clashes(docs)), plain.columns) == rows
    assert f(docs.limit(0)).count() == 0


def test_benchmark_edges(spark, make_docs, edge_rows, with_clashes):
    items = spark.createDataFrame([(1, edge_rows[0][1]), (2, edge_rows[0][1]), (3, None), (4, ""), (5, "short"), (None, edge_rows[6][1])], "item_id long, text string")
    docs = make_docs([*edge_rows, (None, edge_rows[0][1], "en", "s1", 1), (1, edge_rows[0][1], "en", "s1", 1)])
    found = contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d, i) for d in (1, 2, 3, None) for i in (1, 2)} | {(7, None)}
    left = drop_contaminated(with_clashes(docs), items)
    assert left.columns[:5] == docs.columns and left.count() == docs.count() - 6
    assert contaminated(docs, items.limit(0)).count() == 0 and contaminated(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count() and drop_contaminated(docs.limit(0), items).count() == 0


def test_page_edges(spark, page_rows, with_clashes, tmp_path):
    pages = spark.createDataFrame([*page_rows, page_rows[0], page_rows[4], (None, None, None)], PAGES)
    wide = with_clashes(pages)
    a, b = (read_warc(write_warc(x, f"file://{tmp_path}/{k}")) for k, x in enumerate((pages, wide)))
    assert a.count() == pages.count() and told(a, a.columns) == told(b, a.columns)
    assert read_warc(write_warc(pages.limit(0), f"file://{tmp_path}/none")).count() == 0
    a, b = judge_urls(pages), judge_urls(wide)
    assert a.count() == pages.count() and told(a, a.columns) == told(b, a.columns)
    assert judge_urls(pages.limit(0)).count() == 0


def test_entry_lists_one_query_an_operator():
    import __spark_entry__ as e

    numbers = sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in e.queries()


def test_nothing_else_imports_llm():
    import subprocess
    import sys

    code = "import importlib, pathlib, sys; ps = [p for p in pathlib.Path('loomscan').rglob('*.py') if 'llm' not in p.parts]; [importlib.import_module('.'.join(p.with_suffix('').parts)) for p in ps]; assert not any('loomscan.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_scratch_follows_the_session():
    from types import SimpleNamespace as Fake

    from loomscan.llm.common import scratch

    def session(master, folder):
        return Fake(conf=Fake(get=lambda key, default: folder), sparkContext=Fake(master=master, getConf=dict))

    assert scratch(session("spark://x:7077", "hdfs://shared"), "x").startswith("hdfs://shared/loomscan/x-")
    local = session("local[4]", None)
    assert scratch(local, "x").rsplit("/", 1)[0] == scratch(local, "y").rsplit("/", 1)[0]
    for master in ("spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch(session(master, None), "x")


def test_repeated_documents_are_mixed_alike(make_docs):
    docs = make_docs([(1, "a b c", "en", "s", 1)] * 3 + [(2, "a b", "en", None, 1)])
    got = fair_queue_mix(docs)
    assert got.agg(F.sum("taken")).first()[0] <= 1.5 * 11 and got.count() == 4


def test_clean_up_removes_only_what_the_session_wrote(spark, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    from loomscan.llm.common import clean_up, materialize, workspace

    folder = lambda df: Path(urlparse(df.inputFiles()[0]).path).parent
    other = folder(materialize(spark.range(3), "other"))
    monkeypatch.setattr(spark.sparkContext, "_loomscan_folders", set())
    with workspace(spark):
        inside = folder(materialize(spark.range(3), "inside"))
    mine = folder(materialize(spark.range(3), "mine"))
    assert mine.parent == other.parent and mine.parent.name == "loomscan" and spark.sparkContext.applicationId in mine.name
    assert other.exists() and mine.exists() and not inside.exists()
    clean_up(spark)
    assert other.exists() and not mine.exists()
