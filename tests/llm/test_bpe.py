import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import bpe

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "é", "é", " ", "  ", "   ", "\n", " \n", "\t", "\x1c", "\x1f", "\x85", " ", "'s", "'LL", "1", "²", "٣", "中", "😀", "İ", "Σ", "ß", "<|endoftext|>", "<|startoftext|>", "###", "The", "ing", "​", " ", " ", "\x00", "ﬁ", "ᄀ", "ᅡ", "supercalifragilistic"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def ids_of(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_encodes_and_decodes_as_the_library():
    own, library = bpe.ByteEncoder(bpe.Vocabulary(open(BYTES, encoding="utf-8").read())), Tokenizer.from_file(BYTES)
    for t in texts(4000, 1):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(own.encode(t)) == want
        assert own.decode(own.encode(t)) == library.decode(want, skip_special_tokens=False) == t


def test_counts_as_the_library():
    own, library = bpe.WordCounter(bpe.Vocabulary(open(WORDS, encoding="utf-8").read())), Tokenizer.from_file(WORDS)
    for t in texts(4000, 2):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_merging_a_long_piece_stays_fast():
    own = bpe.ByteEncoder(bpe.Vocabulary(open(BYTES, encoding="utf-8").read()))
    library = Tokenizer.from_file(BYTES)
    t = "ab" * 20000
    assert ids_of(own.encode(t)) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    library, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    coded, counted = bpe.encode_documents(docs, BYTES).collect(), bpe.count_tokens(docs, WORDS).collect()
    given = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert [(r["doc_id"], ids_of(bytes(r["ids"])), r["decoded"]) for r in coded] == [(i, library.encode(t, add_special_tokens=False).ids, t) for i, t in given]
    assert [tuple(r) for r in counted] == [(i, len(t.encode()), len(words.encode(t, add_special_tokens=False).ids)) for i, t in given]
