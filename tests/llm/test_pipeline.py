"""The pipeline's stages on the small tables and on hard rows, and the registered queries of the subpackage."""

from __future__ import annotations

import zlib
from itertools import accumulate

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from chainage.llm.common import stored
from chainage.llm.pii_surrogates import PATTERN
from chainage.llm.simhash_pivots import near_duplicates
from oracle_check import compare, duck
from test_operators import SCHEMA, brute_components, brute_contamination, brute_fingerprint, brute_ratios, rows_of

SMALL = "/root/testdata/sf0.001"


def test_stages_return_documents_and_take_hard_rows(spark):
    given = spark.createDataFrame(rows_of(1), SCHEMA)
    for docs in (given, given.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == given.columns
        assert stage(spark, docs, SMALL).count() <= docs.count()


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (_, rules), (_, dedup), (_, clean), (_, pii), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, SMALL)
    one = dedup(spark, kept, SMALL)
    assert one.count() == near_duplicates(kept).select("component_id").distinct().count()
    pure = clean(spark, one, SMALL)
    private = pii(spark, pure, SMALL)
    assert private.count() == pure.count() <= one.count() <= kept.count() < docs.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.select("doc_id").distinct().count() == private.count()
    assert pack(spark, private, SMALL).count() == whole.count()


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_registered_queries_equal_their_sql(spark, name):
    assert compare(spark, duck(SMALL), name, SMALL) is None


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_registered_queries_run(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    table = {"op6": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    assert got.count() >= spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def plain_stages(rows, labels, items):
    """(name, rows) after each filtering stage, in plain Python; ``rows`` are (doc_id, text) with distinct ids."""
    rows = [r for r, (_, kept) in zip(rows, brute_ratios(rows, labels), strict=True) if kept]
    yield "quality_rules", rows
    prints = {i: brute_fingerprint(t) for i, t in rows}
    head = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    first: dict = {}
    for i, _ in rows:
        first[head[prints[i]]] = min(i, first.get(head[prints[i]], i))
    rows = [(i, t) for i, t in rows if first[head[prints[i]]] == i]
    yield "near_duplicates", rows
    verdicts = brute_contamination(rows, items)
    yield "decontamination", [r for r, v in zip(rows, verdicts, strict=True) if not v[-1]]


def test_stages_equal_a_plain_version(spark):
    """Ids and texts after every stage, each on what the one before it kept; the plain side never sees Spark's rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept, now, sizes = [], docs, [len(rows)]
    for name, kept in plain_stages(rows, labels, items):
        now = stored(stages[name](spark, now, SMALL), "compared")
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(kept), name
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] > sizes[2] > 0
    find = regex.compile(PATTERN)
    private = stored(stages["pii"](spark, now, SMALL), "compared")
    after = {r.doc_id: r for r in private.collect()}
    assert sorted(after) == sorted(i for i, _ in kept)
    changed = 0
    for i, text in kept:
        # What lies between findings stays, in its place; every finding is replaced.
        spans, new, end, at = [m.span() for m in find.finditer(text)], after[i].text, 0, 0
        assert (new == text) == (not spans) and after[i].n_chars == len(new if spans else text)
        for begin, after_it in [*spans, (len(text), len(text))]:
            between = text[end:begin]
            at = new.index(between, at) + len(between)
            end = after_it
        assert new.startswith(text[: spans[0][0]] if spans else text) and new.endswith(text[end:])
        assert not any(text[b:e] in new for b, e in spans)
        changed += bool(spans)
    assert changed
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed: dict = {}
    places: dict = {}
    for r in stages["packing"](spark, private, SMALL).collect():
        packed.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, doc in after.items():
        ids = [*encoder.encode(doc.text, add_special_tokens=False).ids, 1]
        cut = [ids[p : p + 4096] for p in range(0, len(ids), 4096)]
        want = [(n, n * 4096, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for n, c in enumerate(cut)]
        assert sorted(packed.pop(i)) == want
    assert not packed
    for spans in places.values():
        ends = [0, *accumulate(n for _, n in sorted(spans))]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 4096
