"""Token ids of texts by a public tokenizer, inside Arrow batches."""

from __future__ import annotations

from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_200_000
#: Characters of the texts whose chunks are looked up together, and words that go to the library as one text.
CHARACTERS = 1 << 23
TOGETHER = 256
#: Characters that the tokenizer's pattern splits off a preceding letter, unless lower case or composition makes that letter end in a mark.
TAIL = '.,!?;:%*&$#"()[]{}-_/+=@^~|'
#: The id that ends each document.
END = 2
#: Texts with the tokenizer's special strings, or with characters that are white space to Python alone, go to the library whole.
_WHOLE = ("<|startoftext|>", "<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lower(text: str) -> str:
    """The text in lower case where that is what the tokenizer makes of it: in Latin-1, which has no letters that compose or change their number."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """encode_all(texts) gives the ids of the tokenizers library as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and its merges never cross it, so the ids
    of a text are those of its chunks between white space, one after the other.
    Its pattern also splits a letter from punctuation behind it; for letters
    of Latin-1, where the library confirms it for each, a space goes in between
    before chunks are told apart, so that a word has one chunk whatever follows.
    The library encodes each chunk once and its ids are kept under a number; it
    is asked once for each different chunk of some texts, whose ids are then
    gathered together. Many new words go to it in one call: a word of letters
    is one piece of the pattern, so its ids end at the first id of a word's
    end. Lower-case words of Latin-1 are what normalizer and pattern leave as
    they are, so they go to the library's model without the two.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        # the model behind a plain split at white space, for words of ASCII and of Latin-1
        self.ascii, self.latin = Tokenizer(self.library.model), Tokenizer(self.library.model)
        self.ascii.pre_tokenizer = WhitespaceSplit()
        self.latin.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ids: dict[str, int] = {}
        self._forget()
        self.apart: dict[str, bool] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # by a letter's last byte; those of two bytes begin with C3
        self.letter, self.tail = np.zeros((2, 256), bool), np.zeros(256, bool)
        for c in filter(self._splits, map(chr, (*range(0x80), *range(0xC0, 0x100)))):
            self.letter[len(c.encode()) - 1, c.encode()[-1]] = True
        self.tail[list(TAIL.encode())] = True

    def _forget(self) -> None:
        self.ids.clear()
        self.flat, self.stops = bytearray(), bytearray(8)

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Keeps stretches of ids, one after the other, and returns their numbers."""
        first = len(self.stops) // 8 - 1
        self.stops += (np.cumsum(lengths, dtype=np.int64) + len(self.flat) // 4).tobytes()
        self.flat += ids.astype(np.uint32).tobytes()
        return range(first, first + len(lengths))

    def _kept(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of stretches, one after the other."""
        stops = np.frombuffer(self.stops, np.int64)
        lengths = stops[numbers + 1] - stops[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(stops[numbers + 1] - ends, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(self.flat, np.uint32)[places], lengths

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _splits(self, letter: str) -> bool:
        """Whether the library gives a word's last letter and punctuation behind it ids of their own."""
        if letter not in self.apart:
            self.apart[letter] = False
            if letter.isalpha():
                whole, first, rest = self._library([letter + TAIL, letter, TAIL])
                self.apart[letter] = whole.tolist() == [*first, *rest]
        return self.apart[letter]

    def _spaced(self, texts: pa.LargeStringArray) -> pa.LargeStringArray:
        """The texts with a space between a letter of Latin-1 and punctuation behind it."""
        offsets, data = np.frombuffer(texts.buffers()[1], np.int64), np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = np.flatnonzero(self.letter.any(0)[data[:-1]] & self.tail[data[1:]]) + 1
        last = data[at - 1]
        at = at[np.where(last < 0x80, self.letter[0, last], (data[at - 2] == 0xC3) & self.letter[1, last])]
        offsets = offsets + np.searchsorted(at, offsets)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.insert(data, at, 0x20)))

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.update(zip(chunks, self._keep(ids, lengths), strict=True))

    def _add_pieces(self, chunks: list[str]) -> None:
        some = self._library(chunks)
        self._add(chunks, np.concatenate(some or [np.zeros(0, np.uint32)]), np.array([len(x) for x in some], np.int64))

    def _add_words(self, words: list[str], library) -> None:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else []
            if len(stops) == len(group):
                self._add(group, ids, np.diff(stops, prepend=0))
            else:  # lower case or composition made more than one piece of a word
                self._add_pieces(group)

    def _learn_others(self, chunks: list[str]) -> None:
        """Chunks that are a word with punctuation behind it have the ids of both; all others go to the library as they are."""
        whole, folded, cores, tails, ready = [], [], [], [], []
        for c in chunks:
            if c.isascii():
                # what is of ASCII alone has the ids of its lower case
                if (low := c.lower()) == c:
                    whole.append(c)
                else:
                    folded.append((c, low))
            elif (core := c.rstrip(TAIL)) is c or not core or "'" in c or "<" in c or not self._splits(core[-1]):
                whole.append(c)
            else:
                ready.append(c)
                cores.append(core)
                tails.append(c[len(core) :])
        new = {x for x in (*whole, *(low for _, low in folded), *cores, *tails) if x not in self.ids}
        self._add_pieces([x for x in new if not x.isalpha()])
        self._add_words([x for x in new if x.isalpha()], self.library)
        self.ids.update((c, self.ids[low]) for c, low in folded)
        if ready:
            ids, lengths = self._kept(np.array([self.ids[x] for pair in zip(cores, tails, strict=True) for x in pair]))
            self._add(ready, ids, lengths.reshape(-1, 2).sum(1))

    def _learn(self, chunks: pa.LargeStringArray) -> None:
        for library, letters in ((self.ascii, "a-z"), (self.latin, "a-zßà-öø-ÿ")):
            words = pc.match_substring_regex(chunks, rf"\A[{letters}]+\z")
            self._add_words(_strings(chunks.filter(words)), library)
            chunks = chunks.filter(pc.invert(words))
        self._learn_others(_strings(chunks))

    def _numbers(self, chunks: pa.LargeStringArray) -> np.ndarray:
        """The numbers of each of some different chunks."""
        names = _strings(chunks)
        numbers = np.fromiter(map(self.ids.get, names, repeat(-1)), np.int64, len(names))
        if new := int((numbers < 0).sum()):
            if len(self.ids) + new > REMEMBERED:
                self._forget()
                numbers[:] = -1
            new = numbers < 0
            self._learn(chunks.filter(pa.array(new)))
            numbers[new] = [self.ids[c] for c in compress(names, new)]
        return numbers

    def _gathered(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special strings."""
        words = pc.utf8_split_whitespace(self._spaced(pa.array(texts, pa.large_string())))
        chunks = words.values.dictionary_encode()
        ids, lengths = self._kept(self._numbers(chunks.dictionary))
        offsets = np.cumsum(np.append(0, 4 * lengths))
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).take(chunks.indices)
        ends, data = np.frombuffer(whole.buffers()[1], np.int64), memoryview(whole.buffers()[2] or b"")
        stops = ends[words.offsets.to_numpy()].tolist()
        return [bytes(data[begin:stop]) for begin, stop in zip(stops[:-1], stops[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some: dict[int, str] = {}
        held = 0
        for i, text in enumerate(map(_lower, texts)):
            if any(x in text for x in _WHOLE):
                out[i] = self._library([texts[i]])[0].tobytes()
                continue
            if held and held + len(text) > CHARACTERS:
                for at, ids in zip(some, self._gathered(list(some.values())), strict=True):
                    out[at] = ids
                some, held = {}, 0
            some[i] = text
            held += len(text)
        if some:
            for at, ids in zip(some, self._gathered(list(some.values())), strict=True):
                out[at] = ids
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
