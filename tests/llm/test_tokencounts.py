"""Token counts against the libraries on whole texts."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from instructset.llm import bpe, queries, tokencounts

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def mixed_text(rng: random.Random, n: int) -> str:
    parts = [*"abcXYZ019.,!?'", " ", " ", " ", " ", "  ", "\n", "\t", "'s", "'re", " re", "é", "́", "ſ", "ａ", "Ⅷ", "日本", "😀",
             "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "▁", "the ", "word and word "]
    return "".join(rng.choice(parts) for _ in range(n))


def library_counts(name: str, texts: list[str]) -> list[int]:
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return [len(model.encode(t)) for t in texts]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["", " ", "\n", "x" * 200_000, "日本語" * 30_000, "a b" * 40_000, *(mixed_text(rng, rng.randrange(400)) for _ in range(300))]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_count_as_the_whole(texts, name, monkeypatch):
    with open(public_tokenizers.path(name), "rb") as file:
        own = tokencounts.counter(name.rsplit(".")[-1], file.read())
    assert own.keep is not None
    want = library_counts(name, texts)
    assert own.counts(texts).tolist() == want
    # Cuts at nearly every safe place, and calls of a few texts.
    monkeypatch.setattr(tokencounts, "PIECE_CHARS", 2)
    monkeypatch.setattr(tokencounts, "CALL_BYTES", 500)
    few = [*texts[:3], *texts[5:]]
    assert any(len(own.pieces(t)) > 5 for t in few)
    assert own.counts(few).tolist() == [*want[:3], *want[5:]]


def test_a_long_text_is_cut_into_balanced_pieces():
    with open(public_tokenizers.path(NAMES[0]), "rb") as file:
        own = tokencounts.counter("json", file.read())
    pieces = own.pieces("some words here " * 40_000)
    assert "".join(pieces) == "some words here " * 40_000
    assert len(pieces) > 9 and max(map(len, pieces)) < tokencounts.PIECE_CHARS + 40


def test_the_library_gets_what_comes_again_once(monkeypatch):
    with open(public_tokenizers.path(NAMES[0]), "rb") as file:
        own = tokencounts.LibraryCounter(file.read())
    given = []
    fragments = bpe.Encoder.fragments
    monkeypatch.setattr(bpe.Encoder, "fragments", lambda self, new: given.extend(new) or fragments(self, new))
    texts = ["alpha beta, gamma! " * 500 + f"the {i}th" for i in range(20)]
    assert own.counts(texts).tolist() == library_counts(NAMES[0], texts)
    assert 0 < sum(map(len, given)) < 0.01 * sum(map(len, texts))


@pytest.mark.parametrize(
    "change",
    [lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s.update(normalizer={"type": "Lowercase"}),
     lambda s: s["model"].update(ignore_merges=True), lambda s: s["added_tokens"][0].update(lstrip=True)],
)
def test_tokenizers_of_other_kinds_get_whole_texts(change):
    with open(public_tokenizers.path(NAMES[0])) as file:
        spec = json.load(file)
    change(spec)
    texts = ["Words and <|endoftext|> more WORDS, again and again.", " The  end", ""]
    whole = Tokenizer.from_str(json.dumps(spec))
    assert not tokencounts.by_fragments(spec)
    got = tokencounts.LibraryCounter(json.dumps(spec).encode()).counts(texts)
    assert got.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_unknown_kinds_of_files_are_refused(docs_of):
    with pytest.raises(ValueError, match="should be a .json"):
        tokencounts.count_tokens(docs_of(["a"]), public_tokenizers.path("byte_bpe_50k.tiktoken"))


ROWS = [(7, "A few words."), (3, None), (5, ""), (9, "many words " * 9000), (7, "A few words."), (None, "x\x0b y"), (1, "<|endoftext|> é")]


def test_op11(docs_of, folder_of, spark):
    got = queries.QUERIES["op11_token_counts"](spark, folder_of(documents=docs_of(ROWS))).collect()
    counts = library_counts(NAMES[0], [t or "" for _, t in ROWS])
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(ROWS, counts, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op11_over_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], library_counts(NAMES[0], [d.text or "" for d in docs]), strict=True))
    got = queries.QUERIES["op11_token_counts"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)


def test_empty_table_and_clashing_columns(spark, docs_of, folder_of):
    assert queries.QUERIES["op11_token_counts"](spark, folder_of(documents=docs_of([]))).collect() == []
    df = spark.createDataFrame([Row(doc_id=1, n_tokens="two words", over_limit="x", n_bytes=None)], "doc_id int, n_tokens string, over_limit string, n_bytes int")
    got = tokencounts.count_tokens(df, public_tokenizers.path(NAMES[2]), text="n_tokens", limit=1)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert [tuple(r) for r in got.collect()] == [(1, 9, library_counts(NAMES[2], ["two words"])[0], True)]
