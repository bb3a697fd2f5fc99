"""Quality rules (operator 1): base rules and divergence from language references."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import begin, bounded, freed, materialize, ship, table, workspace

#: Frequent function words of four languages; their shares, and the share of all other words, are the word histogram.
COMMON = tuple(
    dict.fromkeys(
        (
            "the of and to in a is that for it was on are as with be by at this from or an not but he his they have had "
            "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
            "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es aus er "
            "el y los del las por con no su para al lo como o pero más"
        ).split()
    )
)
#: Character classes, the rest is the last one. Code points above 127 are a class of their own.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r", ".,;:!?", "'\"()-")
N_CLASSES = len(CLASSES) + 2
MARKS = ".,;:!?"
BLANK = " \t\n\x0b\x0c\r"
SLICE = 512

_WORD_AT = {w.encode(): k for k, w in enumerate(COMMON)}
_CLASS_OF = np.full(256, N_CLASSES - 1)
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        _CLASS_OF[ord(_c)] = _k
_CLASS_OF[0x80:0xC0] = N_CLASSES  # bytes that continue a code point count for nothing
_CLASS_OF[0xC0:] = N_CLASSES - 2
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of so many words that is found twice or more."""
    windows = list(zip(*(words[k:] for k in range(window))))
    if len(windows) < 2 or len(counts := Counter(windows)) == len(windows):
        return 0
    marked = bytearray(len(words))
    for k, w in enumerate(windows):
        if counts[w] > 1:
            marked[k : k + window] = b"\1" * window
    return sum(marked)


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class histogram, common-word histogram."""
    data = text.encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(_CLASS_OF, weights=counts, minlength=N_CLASSES + 1)[:N_CLASSES].astype(int).tolist()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    common = [0] * (len(COMMON) + 1)
    for w in text.lower().encode().split():
        if len(w) < 12:
            common[_WORD_AT.get(w.strip(b".,;:!?"), -1)] += 1
        else:
            common[-1] += 1
    return len(words), len(text) - sum(map(text.count, BLANK)), int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), classes, common


_SPARK = {pa.int64(): LongType(), pa.bool_(): BooleanType(), pa.list_(pa.int32()): ArrayType(IntegerType())}
_FIELDS = [*((n, pa.int64()) for n in ("n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("classes", pa.list_(pa.int32())), ("common", pa.list_(pa.int32()))]


def _measured(rows: DataFrame) -> DataFrame:
    """Any columns and _text in; all but _text, counts, base_failed and the two histograms out. One pass, no shuffle."""
    carried = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches):
        begin("quality")
        for batch in freed(batches):
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [t or "" for t in part.column(part.schema.get_field_index("_text")).to_pylist()]
                rows = [measure(t) for t in texts]
                failed = [r[0] < 10 or 100 * r[4] > 20 * r[0] for r in rows]
                columns = [[r[0] for r in rows], list(map(len, texts)), *([r[j] for r in rows] for j in range(1, 5)), failed, [r[5] for r in rows], [r[6] for r in rows]]
                made = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in carried), *made], names=[f.name for f in carried] + [n for n, _ in _FIELDS])

    schema = StructType([*carried, *(StructField(n, _SPARK[t]) for n, t in _FIELDS)])
    return rows.mapInArrow(run, schema)


_SUMS = "lang string, n_words long, classes array<long>, common array<long>"


def _packed(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(sums, pa.string()), "n_words": pa.array([int(s[0]) for s in sums.values()], pa.int64()), "classes": pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.int64())), "common": pa.array([s[2].tolist() for s in sums.values()], pa.list_(pa.int64()))})


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """lang, ref_classes, ref_common: summed histograms of all documents of a language that pass the base rules.

    Summed per task before the shuffle. A language whose documents have fewer than min_words words has no reference.
    """

    def run(batches):
        sums: dict[str | None, list] = {}
        for batch in batches:
            langs, words, classes, common = (batch.column(k) for k in range(4))
            a, b = (np.asarray(c.flatten()).reshape(batch.num_rows, -1) for c in (classes, common))
            names, n = np.asarray(langs.to_pylist(), object), np.asarray(words)
            for lang in dict.fromkeys(names.tolist()):
                at = names == lang
                s = sums.setdefault(lang, [0, 0, 0])
                for k, x in enumerate((n[at].sum(), a[at].sum(0, dtype=np.int64), b[at].sum(0, dtype=np.int64))):
                    s[k] = s[k] + x
            if len(sums) > 1000:
                yield _packed(sums)
                sums = {}
        if sums:
            yield _packed(sums)

    passed = measured.filter("not base_failed and lang is not null").select("lang", "n_words", "classes", "common")
    sums = passed.mapInArrow(run, _SUMS)

    return _totals(sums, min_words)


def _totals(sums: DataFrame, min_words: int) -> DataFrame:
    def total(c: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(f"ref_{c}")

    out = sums.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), total("classes", N_CLASSES), total("common", len(COMMON) + 1))
    return out.filter(F.col("ref_words") >= min_words).drop("ref_words")


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = 2000) -> DataFrame:
    """References for judge_quality from documents that are known to be good: lang, ref_classes, ref_common."""
    ship(docs.sparkSession)

    def run(batches):  # measured and summed by one worker, so that a task doesn't hold two
        begin("quality")
        sums: dict[str, list] = {}
        for batch in freed(batches):
            for k in range(0, batch.num_rows, SLICE):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns)):
                    n, _, _, _, repeats, classes, common = measure(text or "")
                    if lang is not None and n >= 10 and 100 * repeats <= 20 * n:
                        s = sums.setdefault(lang, [0, np.zeros(N_CLASSES, np.int64), np.zeros(len(COMMON) + 1, np.int64)])
                        s[0] += n
                        s[1] += classes
                        s[2] += common
                if len(sums) > 1000:
                    yield _packed(sums)
                    sums = {}
        if sums:
            yield _packed(sums)

    return _totals(docs.select(F.col(lang_col), F.col(text_col)).mapInArrow(run, _SUMS), min_words)


def js_distance(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two histograms, rounded to 6 places.

    n_a and n_b are the histograms' sums, given as columns: a sum inside the lambda would be made anew for each element.
    """

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(F.transform(a, lambda v: v / n_a), F.transform(b, lambda v: v / n_b), lambda p, q: (half(p, (p + q) / 2) + half(q, (p + q) / 2)) / 2)
    return F.round(F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))), 6)


def _judged(measured: DataFrame, refs: DataFrame | None, min_words: int, min_reference_words: int, class_limit: tuple[float, float], word_limit: tuple[float, float]) -> DataFrame:
    """measured with js_classes, js_common and kept."""
    refs = references(measured, min_reference_words) if refs is None else refs.select("lang", "ref_classes", "ref_common")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    refs = refs.select(F.col("lang").alias("ref_lang"), *[f(F.col(f"ref_{c}")).alias(n) for c in ("classes", "common") for f, n in ((lambda x: x, f"ref_{c}"), (total, f"ref_n_{c}"))])
    refs = bounded(materialize(refs, "quality-refs", keep=True))  # the sums are columns of a table: nothing computes them again
    x = measured.join(refs, (F.col("lang") == F.col("ref_lang")) & (F.col("n_words") >= min_words), "left")
    for c, n in (("classes", "n_chars"), ("common", "n_words")):
        x = x.withColumn(f"js_{c}", F.when(F.col("ref_lang").isNotNull(), js_distance(F.col(c), F.col(n), F.col(f"ref_{c}"), F.col(f"ref_n_{c}"))))
    over = [F.coalesce(F.col(f"js_{c}") > a + b / F.sqrt("n_words"), F.lit(False)) for c, (a, b) in (("classes", class_limit), ("common", word_limit))]
    return x.withColumn("kept", ~F.col("base_failed") & ~over[0] & ~over[1])


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None, min_words: int = 50, min_reference_words: int = 2000, class_limit: tuple[float, float] = (0.2, 1.0), word_limit: tuple[float, float] = (0.22, 1.4)) -> DataFrame:
    """Base counts and verdict of each document: id, counts, base_failed, kept, js_classes, js_words.

    A document's histograms of character classes and of common words are held against its language's reference: that of
    a table `references` (lang, ref_classes, ref_common, as language_references makes it of good documents), or, without
    one, of all documents of the language that pass the base rules. It is rejected if a Jensen-Shannon distance is over
    a + b / sqrt(n_words), with (a, b) from class_limit and word_limit: the second part allows for the noise of short
    texts. Documents of fewer than min_words words, and those without a language or a reference, aren't judged by
    distance (js columns null); they are kept unless the base rules fail. A corpus-made reference takes
    min_reference_words words of the language.

    Null texts have no words, so they fail. Rows that repeat are judged alike; an empty table gives no rows; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    with workspace(docs.sparkSession):
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
        measured = materialize(_measured(rows), "quality", keep=True)
        x = _judged(measured, references, min_words, min_reference_words, class_limit, word_limit)
    return x.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_classes", F.col("js_common").alias("js_words"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None, min_words: int = 50, min_reference_words: int = 2000, class_limit: tuple[float, float] = (0.2, 1.0), word_limit: tuple[float, float] = (0.22, 1.4)) -> DataFrame:
    """The rows that judge_quality keeps, with their columns; each row has its own verdict, whatever its id.

    Rows go through the workers with their counts. Without references, texts are measured once more before, for the
    corpus-made ones, which are all that is stored: that costs less than a copy of the texts on disk.
    """
    ship(docs.sparkSession)
    if references is None:
        references = language_references(docs, text_col, lang_col, min_reference_words)
    rows = docs.select(F.struct("*").alias("row"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    return _judged(_measured(rows), references, min_words, min_reference_words, class_limit, word_limit).filter("kept").select("row.*")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def escaped(chars: str) -> str:
        return "".join(f"\\x{ord(c):02X}" for c in chars)

    classes = [f"len(regexp_extract_all(t, '[{escaped(c)}]'))" for c in CLASSES] + ["length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"]
    classes.append(f"length(t) - {' - '.join(classes)}")
    words = ", ".join(f"'{w}'" for w in COMMON)

    def js(a: str, b: str) -> str:
        p, q = f"({a}[i] / list_sum({a})::DOUBLE)", f"({b}[i] / list_sum({b})::DOUBLE)"
        half = f"CASE WHEN {{0}} > 0 THEN {{0}} * log2({{0}} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({half.format(p)} + {half.format(q)}) / 2)), 0)), 6)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i+4], ' ')) AS n FROM u),
rp AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r),
lw AS (SELECT r, list_transform(list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
                                lambda x: CASE WHEN strlen(x) < 12 THEN trim(x, '{MARKS}') ELSE '' END) AS cw FROM d),
m AS (SELECT w.r, doc_id, lang, len(ws)::BIGINT AS n_words, (length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, [{', '.join(classes)}] AS classes,
             list_transform([{words}], lambda c: coalesce(list_aggregate(cw, 'histogram')[c], 0)::BIGINT) AS c0
      FROM w JOIN lw ON w.r = lw.r LEFT JOIN rp ON w.r = rp.r),
b AS (SELECT *, list_append(c0, n_words - list_sum(c0)) AS common, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT lang, k, i, sum(v) AS v FROM (
        SELECT lang, 1 AS k, unnest(classes) AS v, generate_subscripts(classes, 1) AS i FROM b WHERE NOT base_failed AND lang IS NOT NULL
        UNION ALL SELECT lang, 2, unnest(common), generate_subscripts(common, 1) FROM b WHERE NOT base_failed AND lang IS NOT NULL) GROUP BY ALL),
n AS (SELECT lang FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 2000),
ref AS (SELECT lang, list(v ORDER BY i) FILTER (WHERE k = 1) AS rc, list(v ORDER BY i) FILTER (WHERE k = 2) AS rw FROM f JOIN n USING (lang) GROUP BY lang),
j AS (SELECT b.*, CASE WHEN rc IS NOT NULL THEN {js('classes', 'rc')} END AS js_classes, CASE WHEN rc IS NOT NULL THEN {js('common', 'rw')} END AS js_words
      FROM b LEFT JOIN ref ON b.lang = ref.lang AND b.n_words >= 50)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(js_classes > 0.2 + 1.0 / sqrt(n_words), false) AND NOT coalesce(js_words > 0.22 + 1.4 / sqrt(n_words), false) AS kept,
       js_classes, js_words
FROM j
"""


QUERIES = {"op1_quality_divergence": op1_quality_divergence}
ORACLES = {"op1_quality_divergence": _sql()}
