"""Nulls, empty and very long texts, repeated rows, ties and empty tables, for operators and the pipeline's stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import chat, decontaminate, langid, simhash, token_store, urls
from rowloom.llm.components import written

DATA = "/root/testdata/sf0.001"
WORDS = [f"word{i}" for i in range(500)]


def text_of(seed, n=80):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_chat_without_rows_and_with_a_long_text(spark):
    schema = "conv_id long, turn long, role string, text string, node string, rank int"
    empty = spark.createDataFrame([], schema)
    assert chat.digests(chat.format_conversations(empty)).count() == 0
    long = "x<|y </s> \\ é" * 30_000
    turns = spark.createDataFrame([(1, 0, "user", long, "n", 1), (1, 1, "assistant", long, "n", 1), (2, 0, "user", long, "n", 1)], schema)
    got = {r["conv"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["loss_chars"]) == (2, len(long), 0)


def test_decontamination_of_hard_documents(spark):
    item = text_of(1, 30)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (3, item), (None, "short one")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, text_of(2, 40_000) + " " + item + " " + text_of(3, 40_000)), (None, item), (5, item), (5, item), (6, text_of(4))]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, item_id string, distance int")
    found = decontaminate.contaminated(docs, items).collect()
    assert Counter(r["doc_id"] for r in found if r["item_id"] == 1) == {3: 1, None: 1, 5: 2}
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 6]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()


def test_languages_of_no_documents(spark):
    docs = spark.createDataFrame([(1, "the river runs", "en", 1), (2, "der fluss fließt", "de", 2)], "doc_id long, text string, lang string, score int")
    model = langid.train(docs)
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.keep_known(docs.limit(0), model).count() == 0
    assert langid.predict(docs, model).columns == ["doc_id", "lang", "lang_pred", "score"]


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://" + "a" * 50_000 + ".org/y"), (None, None)], "page_id long, url string")
    rules = [urls.Rule("block", "a.org", "/x"), urls.Rule("allow", "a.org", "/x")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert got[1] == "allow" and len(got) == 3 and urls.judge(pages.limit(0), rules).count() == 0


def hard_documents():
    base = {i: text_of(100 + i) for i in range(12)}
    rows = [(i, t) for i, t in base.items()]
    rows += [(100 + i, t + " some more words here") for i, t in list(base.items())[:5]]
    rows += [(200, base[1]), (200, base[1]), (None, base[2]), (None, text_of(900)), (300, text_of(901, 30_000)), (301, text_of(901, 30_000))]
    rows += [(7, base[8] + " tail"), (400, "word1"), (401, "word1"), (402, None), (403, ""), (404, "  "), (405, "123 456")]
    return [(k, t, "en" if n % 3 else None, f"s{n % 2}" if n % 5 else None, len(t or "")) for n, (k, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(hard_documents(), "doc_id long, text string, lang string, source string, n_chars long")


def plain_classes(rows):
    """All pairs compared by fingerprints; the rows that stay, as the stage's docstrings say."""
    import corpus_pipeline as p

    prints = [(simhash.fingerprint(t, simhash.Fingerprint(1, 0, p.NEAR_TRIES, p.NEAR_WINDOW)), simhash.fingerprint(t, p.SHINGLES)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def bits(a, b):
        return [(x ^ y).bit_count() for x, y in zip(a, b)]

    for i in range(len(rows)):
        for j in range(i):
            (wi, ci), (wj, cj) = prints[i], prints[j]
            if min(bits(wi, wj)) <= p.NEAR_BITS and sum(bits(ci, cj)) <= p.SHINGLE_BITS:
                root[find(i)] = find(j)
    members = {}
    for i, row in enumerate(rows):
        members.setdefault(find(i), []).append(row)
    return [min((k is None, k or 0) for k, _ in group) for group in members.values()]


def test_near_dedup_equals_all_pairs(spark, documents):
    import corpus_pipeline

    kept = corpus_pipeline.one_of_each(spark, documents, DATA)
    rows = kept.collect()
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(plain_classes([(r[0], r[1]) for r in hard_documents()]))
    whole = set(hard_documents())
    assert all(tuple(r) in whole for r in rows)


def test_all_stages_on_hard_rows(spark, documents):
    import corpus_pipeline

    plain = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    docs, counts = documents, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs
        docs = written(stage(spark, docs, DATA), f"stage-{n}")
        counts.append(docs.count())
        if n < 4:
            assert docs.columns == documents.columns, name
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in given.collect()}
    # stage 1: a text without letters has no language
    assert counts[0] == sum(any(c.isalpha() for c in t or "") for _, t, *_ in hard_documents())
    texts = [(r["doc_id"], r["text"]) for r in given.collect()]
    wanted = sorted(zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in texts)
    assert sorted(r["ids_crc32"] for r in docs.collect()) == wanted and token_store is not None
