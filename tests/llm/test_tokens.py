import random

import numpy as np
import public_tokenizers
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F
from sparkfill.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "'s", "'l", "'ll", "'", " ", "  ", "\n", "\t", "!", "é", "字", "1", "23", " ", "\x85", "\x1c", "😀",
         "<|endoftext|>", "<|endof", " x", "\r\n", "\u3000", "ª"]


def test_every_prefix_of_random_texts(make_docs):
    rng, library = random.Random(1), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(400)] + ODD_TEXTS
    for r in tokens.token_counts(make_docs(texts), with_prefixes=True, budgets=(3,)).collect():
        text = texts[r.doc_id] or ""
        want = [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(min(len(text), 60))]
        table = np.frombuffer(r.prefix_counts, "<i4").tolist()
        assert table[:60] == want and len(table) == len(text)
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())
        assert r.cut_3 == max([0, *(i + 1 for i, c in enumerate(table) if c <= 3)])


def test_real_documents(real_docs):
    library, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text for r in real_docs.collect()}
    got = tokens.token_counts(real_docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_stored_table_answers(make_docs):
    out = tokens.token_counts(make_docs(["hello tokenized world", "", None]), with_prefixes=True)
    got = [r.n for r in out.orderBy("doc_id").select(tokens.prefix_tokens(F.col("prefix_counts"), F.lit(5)).alias("n")).collect()]
    assert got[0] == len(Tokenizer.from_file(PATH).encode("hello").ids) and got[1:] == [0, 0]


def test_repeated_rows_and_empty(make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, None)])
    assert sorted((r.n_tokens for r in tokens.token_counts(docs).collect())) == [0, 2, 2]
    assert tokens.token_counts(docs.limit(0)).count() == 0
