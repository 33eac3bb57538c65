"""Exact dedup, tokens, pieces and words on small tables with nulls, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np

from cairn.llm import exact_dedup, pieces, quality_rules, token_files, tokens

TEXTS = ["a b c", "abc", " abc\n", None, "", "zwei  Wörter, it's 3 <|endoftext|> x", "▁ mark  two ", "emoji 😀 é x\x1cy", "word " * 900]


def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, h string")


def test_exact_groups(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark)).collect()}
    assert [got[i] for i in range(5)] == [(0, 3, True), (0, 3, False), (0, 3, False), (3, 2, True), (3, 2, False)]
    # one hash for all: texts are still told apart
    from pyspark.sql import functions as F

    same = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark), hash128=lambda c: F.unhex(F.lit("00"))).collect()}
    assert same == got


def test_token_files(spark):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(tokens.tokenizer_file()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_access_to_a_shard():
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(3, 9, n), 2).astype("<u4") for n in (500, 0, 2000)]
    shard = token_files.Shard(token_files.write_shard([(i, x.tobytes()) for i, x in enumerate(ids)]))
    assert all((a == b).all() for a, (_, b) in zip(ids, shard.documents()))
    assert (shard.read(2, 700, 90) == ids[2][700:790]).all()


def test_pieces(spark):
    sp = pieces.codec(pieces.model_file()).library
    got = {r.doc_id: r for r in pieces.piece_digests(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_agenda_gives_the_ids_and_the_library_is_followed_where_it_differs():
    texts = ["plain words here", "other words"]
    codec = pieces.PieceCodec(pieces.model_file())
    library = [np.array(codec.library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]
    assert codec.encode_all(texts) == library and not codec.followed
    wrong = pieces.PieceCodec(pieces.model_file())
    agenda = wrong.agenda
    wrong.agenda = lambda w: agenda(w) + [5] if "here" in w else agenda(w)
    out = wrong.encode_all(texts)
    assert out == library and wrong.followed == {"▁here"}
    assert [wrong.checked(t, np.frombuffer(d, "<u4").tolist())[1] for t, d in zip(texts, out, strict=True)] == [True, False]


def test_quality_counts(spark):
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert got[8].n_repeat_words == 900 and got[8].base_failed and not got[8].kept
