"""Encoding and decoding with a merge-type (BPE) piece vocabulary.

The encoder keeps an agenda of adjacent symbol pairs, ordered by the score of
the piece that they make and then by place, and merges the best until none is
left. No piece of the vocabulary has the word mark after another character, so
merges never cross the start of a marked word: words are encoded apart and a
dictionary keeps their ids. Every new word and every decoded text is held
against the sentencepiece library in the same Arrow batch; where it differs
from the agenda it is followed, and the row says so (tests see none).
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import text_of

MARK = "▁"
#: Words whose ids a worker remembers, and texts between two looks for new words.
REMEMBERED, TEXTS = 1_000_000, 256
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.vocab: dict[str, tuple[float, int]] = {}
        self.bytes_id, self.piece = {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.piece.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.piece.append(b"")
            elif sp.is_unknown(i):
                self.piece.append(" ⁇ ".encode())
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses the start of a word")
                if not sp.is_unused(i):
                    self.vocab[piece] = (-sp.get_score(i), i)
                self.piece.append(piece.replace(MARK, " ").encode())
        self.ids: dict[str, bytes] = {}
        #: Words where the agenda differed from the library, which was followed.
        self.followed: set[str] = set()

    def agenda(self, word: str) -> list[int]:
        """The ids of a word (marks included)."""
        vocab = self.vocab
        if word in vocab and len(word) == 1:
            return [vocab[word][1]]
        symbols: list[str | None] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := vocab.get(word[i : i + 2]):
                heap.append((hit[0], i, i + 1, word[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, j, made = heapq.heappop(heap)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or left + right != made:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := vocab.get(pair := made + symbols[k]):
                    heapq.heappush(heap, (hit[0], i, k, pair))
            if (h := before[i]) >= 0 and (hit := vocab.get(pair := symbols[h] + made)):
                heapq.heappush(heap, (hit[0], h, i, pair))
        out = []
        for s in symbols:
            if s is None:
                continue
            if hit := vocab.get(s):
                out.append(hit[1])
            elif self.bytes_id:
                out += [self.bytes_id[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return out

    def _learn(self, words: set[str]) -> None:
        made = {w: self.agenda(w) for w in words}
        plain = [w[1:].replace(MARK, " ") for w in words]
        for (w, mine), theirs in zip(made.items(), self.library.encode(plain, num_threads=1), strict=True):
            theirs = theirs or self.library.encode("a ")[-1:]  # a lone mark can only be the end of a text
            if mine != theirs:
                self.followed.add(w)
            self.ids[w] = np.array(theirs if w in self.followed else mine, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def checked(self, text: str, ids: list[int]) -> tuple[str, bool]:
        """(decoded text of the ids, whether the library was followed anywhere in this text)."""
        mine, theirs = self.decode(ids), self.library.decode(ids)
        followed = mine != theirs or bool(self.followed) and not self.followed.isdisjoint(self.words(text))
        return (theirs if mine != theirs else mine), followed

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids with the begin and end id, as little-endian unsigned 32-bit bytes."""
        head, tail = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        out = [head + tail] * len(texts)
        for at in range(0, len(texts), TEXTS):
            later = []
            for i in range(at, min(at + TEXTS, len(texts))):
                if not texts[i]:
                    continue
                words = self.words(texts[i])
                try:
                    out[i] = head + b"".join(map(self.ids.__getitem__, words)) + tail
                except KeyError:
                    later.append((i, words))
            new = set().union(*(w for _, w in later)).difference(self.ids)
            if len(self.ids) + len(new) > REMEMBERED:
                self.ids.clear()
                new = set().union(*(w for _, w in later))
            if new:
                self._learn(new)
            for i, words in later:
                out[i] = head + b"".join(map(self.ids.__getitem__, words)) + tail
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.piece.__getitem__, ids))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                n, digest, decoded, followed = [], [], [], []
                texts = some.column(1).to_pylist()
                for own, data in zip(texts, codec(path).encode_all(texts), strict=True):
                    ids = np.frombuffer(data, "<u4").tolist()
                    text, other = codec(path).checked(own, ids)
                    n.append(len(ids))
                    digest.append(hashlib.sha256(data).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    followed.append(other)
                yield pa.record_batch([some.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(followed)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "followed_library"])

    return run


def encode_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array<bigint>) of each text of ``docs``; null is empty."""
    path = model or model_file()

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype("<i8") for x in codec(path).encode_all(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, ids array<bigint>")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, followed_library: one row per row of ``docs``.

    The ids and the text are the agenda's; where the check against the library
    differs, the library is followed and the row says so.

    A null text counts as empty and has the begin and end id alone. Rows do not
    depend on each other, so ids may be null or repeat; a text of any length is
    encoded whole; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return rows.mapInArrow(_encode(model or model_file()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, followed_library boolean")
