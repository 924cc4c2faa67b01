import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm.eliasfano import EliasFano, encode
from rowloom.llm.token_store import Shard, WordTokenizer, documents_of, read_tokens, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b c", "\n", "a  b", "x　 y z", "don't we'll  stop",
    "é è 日本語 の テキスト", "a b\t", "\ta b", "1 22 333", "<|endoftext|> a <|endoftext|>", "a \x1c b \x85 c", "!! ?? a!! b",
    "word " * 3000, "x" * 5000, " ".join(f"w{i}" for i in range(3000)), "a" + " " * 50 + "b" + " c" * 2000,
]


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return WordTokenizer(PATH, known=50), Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_same_ids_as_whole_texts(pair):
    words, plain = pair
    assert [x.tolist() for x in words.encode(TRICKY)] == [whole(plain, t) for t in TRICKY]
    assert words.encode([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé 1!\n\t \x1c<|>日"), max_size=40), max_size=4))
def test_any_text(pair, texts):
    words, plain = pair
    assert [x.tolist() for x in words.encode(texts)] == [whole(plain, t) for t in texts]


def test_words_by_their_pieces(pair):
    """A new word made of known pieces is not encoded again, and the ids stay those of whole texts."""
    plain = pair[1]
    words = WordTokenizer(PATH)
    words.encode(["go house Straße quinze a, b. c!! 12 x.\nx\nhouse."])
    calls = []
    for name in ("tokenizer", "of_pieces"):
        setattr(words, name, Counted(getattr(words, name), calls))
    text = "go house, Straße. quinze!! house.\nhouse 12, quinze.\nx Straße"
    assert [x.tolist() for x in words.encode([text])] == [whole(plain, text)]
    assert calls == [["go"]]  # the first word, which has no blank before it


class Counted:
    def __init__(self, tokenizer, calls):
        self.tokenizer, self.calls = tokenizer, calls

    def encode_batch_fast(self, texts, **options):
        self.calls.append(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéſɏ'sdmltvre1²,.<|>!\n ª日\t"), max_size=40), max_size=4))
def test_any_word(pair, texts):
    words, plain = pair
    assert [x.tolist() for x in words.encode(texts)] == [whole(plain, t) for t in texts]


def test_other_vocabulary(tmp_path):
    """A vocabulary that cuts texts otherwise, or adds tokens of plain letters, keeps its own ids."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    texts = ["one two, three.\nFour", "x two,, wordy word"]
    for change in ("digits", "added"):
        other = Tokenizer.from_file(PATH)
        if change == "digits":
            other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(), other.pre_tokenizer])
        else:
            other.add_tokens([AddedToken("wordy")])
        other.save(str(tmp_path / f"{change}.json"))
        words = WordTokenizer(str(tmp_path / f"{change}.json"))
        assert not words.cuttable
        assert [x.tolist() for x in words.encode(texts)] == [whole(other, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**60) | st.integers(0, 3000), max_size=2000))
def test_elias_fano(numbers):
    values = np.array(sorted(numbers), np.uint64)
    data = encode(values)
    coded = EliasFano(lambda at, n: data[at : at + n])
    assert coded.all().tolist() == values.tolist()
    assert [coded[i] for i in range(0, len(values), 7)] == values[::7].tolist()


def test_space_of_boundaries():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(encode(values)) * 8 < 100_000 * (2 + 10 + 1.1)


def test_shards(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rows = [(5, "b c"), (None, "null id"), (2, None), (2, ""), (-7, "a  b"), (9, TRICKY[-2]), (9, "same id"), (5, "b c")]
    clashing = "doc_id long, text string, start int, n_tokens int, part string, seq int, key string, path int, ids int, sha string"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, "k", 4, 5, "s") for r in rows], clashing)
    manifest = write_tokens(docs, PATH, shard_ids=8)
    assert manifest.count() > 3
    expected, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole(plain, text or ""), 2], "<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in read_tokens(manifest).collect()), key=lambda r: r[1])
    assert got == expected
    paths = [r["path"] for r in manifest.orderBy("part", "seq").collect()]
    assert [(k, len(ids)) for k, ids in documents_of(spark, paths)] == [(r[0], r[2]) for r in expected]
    shard = Shard(paths[0])
    assert shard.document(0)[1].tolist() == [*whole(plain, "null id"), 2]
    shard.close()


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(docs, PATH)).count() == 0
