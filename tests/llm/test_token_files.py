"""Token ids against the library, the grammar's fixpoint, and token files over rows without or with repeated ids."""

import random
import unicodedata
import zlib

import numpy as np
import pytest

from cairn.llm import token_files, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file())


def encoded(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")


def test_ids_of_all_of_unicode(library):
    rng = random.Random(11)

    def one():
        x = rng.random()
        if x < 0.35:
            return rng.choice(tokens.TAIL + "'<>` \nabXY19İÅßΣς̸̇")
        while unicodedata.category(c := chr(rng.randrange(0x110000 if x < 0.6 else 0x3000))) == "Cs":
            pass
        return c

    texts = ["".join(one() for _ in range(rng.randrange(9))) for _ in range(30_000)] + ["İ.", "Kadıköyİ!", "ਖ਼%", "য়|"]
    for text, got in zip(texts, tokens.WordEncoder(tokens.tokenizer_file()).encode_all(texts), strict=True):
        assert got == encoded(library, text).tobytes(), ascii(text)


@pytest.mark.parametrize("often", [2, 3, 6])
def test_no_pair_is_left_that_pays(often):
    rng = np.random.default_rng(often)
    for n in (0, 1, 2, 30, 400):
        ids = rng.integers(1, 5, n).astype("<u4")
        seq, left, right = token_files.re_pair(ids, base=5, often=often)

        def expand(s):
            return [s] if s < 5 else expand(int(left[s - 5])) + expand(int(right[s - 5]))  # noqa: B023

        assert [x for s in seq.tolist() for x in expand(s)] == ids.tolist()
        for pair in set(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            found = i = 0
            while i < len(seq) - 1:
                hit = (seq[i], seq[i + 1]) == pair
                found, i = found + hit, i + 1 + hit
            assert found < often or tokens.END in pair


def test_rows_without_or_with_repeated_ids(spark, library):
    texts = [(5, "five"), (None, "no id"), (None, None), (5, "another five"), (5, "five"), (-2, "x " * 3000), (9, "")]
    docs = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, part int")
    rows = token_files.token_files(docs).collect()
    want = sorted((i is not None, i or 0, zlib.crc32(np.append(encoded(library, t or ""), 2).astype("<u4").tobytes())) for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, None, -2, 5, 5, 5, 9]
    assert token_files.token_files(docs.limit(0)).collect() == []


def test_case_is_folded_before_words_are_learned(library):
    encoder = tokens.WordEncoder(tokens.tokenizer_file())
    texts = ["Word WORD. word", "Élan ÉLAN, élan ÄÖÜ ß ÿ µ", "a <|STARTOFTEXT|> b<|EndOfText|>c", "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 256))), "x\x85Y\xa0Z", "ΣΑΣ İ Word"]
    for text, got in zip(texts, encoder.encode_all(texts), strict=True):
        assert got == encoded(library, text).tobytes(), ascii(text)
    again = tokens.WordEncoder(tokens.tokenizer_file())
    again.encode_all(texts[:2])
    assert not any(c != c.lower() for c in again.ids)


def test_a_chunk_is_looked_up_once_for_many_texts(library, monkeypatch):
    encoder = tokens.WordEncoder(tokens.tokenizer_file())

    class Counted(type(encoder.ids)):
        looked_up = 0

        def get(self, *a):
            Counted.looked_up += 1
            return super().get(*a)

        def __getitem__(self, chunk):
            Counted.looked_up += 1
            return super().__getitem__(chunk)

    encoder.ids = Counted()
    texts = ["some words, some more\x85words. " * 500, "", " \n", "　words  some ", "<|endoftext|> some"] * 4
    want = [encoded(library, t).tobytes() for t in texts]
    assert encoder.encode_all(texts) == want and Counted.looked_up < 50
    # groups of texts and a memory that is emptied change nothing
    for characters, remembered in ((1, 1 << 20), (30, 2), (40_000, 3)):
        monkeypatch.setattr(tokens, "CHARACTERS", characters)
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        assert tokens.WordEncoder(tokens.tokenizer_file()).encode_all(texts) == want
    assert encoder.encode_all([]) == [] and encoder.encode_all(["<|endoftext|>"]) == [encoded(library, "<|endoftext|>").tobytes()]


def test_a_word_is_one_chunk_whatever_follows_it(library):
    encoder = tokens.WordEncoder(tokens.tokenizer_file())
    texts = ["word word, word. word;word word) Word", "école, école. École;école"]
    assert encoder.encode_all(texts) == [encoded(library, t).tobytes() for t in texts]
    words = [c for c in encoder.ids if c.strip(tokens.TAIL)]
    assert not any(c[-1] in tokens.TAIL for c in words) and {"word", "école"} <= set(words)


def test_words_that_go_to_the_model_alone_have_the_ids_of_the_library(library, monkeypatch):
    encoder = tokens.WordEncoder(tokens.tokenizer_file())
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    texts = [x + y + z for x in letters for y in letters for z in ("", ".", "'s", "́", "<Ω")]
    texts += ["Σ <|STARTOFTEXT|>", "Ω a<|EndOfText|>b", "H̱ ẖ. a≠ a.'s x',s"]
    for text, got in zip(texts, encoder.encode_all(texts), strict=True):
        assert got == encoded(library, text).tobytes(), ascii(text)
    asked = []
    monkeypatch.setattr(encoder, "_library", lambda some: asked.extend(some) or [np.zeros(0, np.uint32)] * len(some))
    encoder.encode_all(["anewword Anotherword, unécole ÉCOLESÀ; ."])
    assert not any(c.isalpha() for c in asked)
