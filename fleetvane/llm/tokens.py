"""Tokenizing whole texts by a public tokenizer: each distinct word goes through the model once while it is remembered.

Texts and ids are bytes (UTF-8, little-endian unsigned 32-bit integers), so the ids of a text are the joined ids of its
chunks. Arrow cuts the texts handed over together and numbers their distinct chunks; Python sees each of these once, and
Arrow puts the ids in their places. What is remembered is bounded by bytes, whatever the corpus holds, and never changes
a result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetvane.llm.common import held

#: Bytes of keys and values that an encoder remembers, and what an entry costs besides.
MOST_BYTES, MOST_SPACED_BYTES, ENTRY_BYTES = 208 << 20, 320 << 20, 120
#: Longer texts are encoded in sections of about so many bytes.
SECTION_BYTES = 1 << 20

#: White space, then a run of other characters. No pre-token of the two vocabularies spans the end of such a chunk.
CHUNK = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: A lone space between two words: no pre-token spans its beginning.
CUT = re.compile(rb"(?<=[^\x20\x09-\x0D])(?=\x20[^\x20\x09-\x0D])")
#: White space beyond ASCII in Unicode's White_Space property, in UTF-8.
OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Text that is all printable ASCII, its white space and Latin-1 letters: lower case and normal form are the same there in all libraries.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Stands between the chunks that are cut into words in one go, and its place among ids (which are smaller).
BETWEEN, MARK = "\0", b"\xff" * 4
#: The two vocabularies' patterns of pre-tokens, for such text; the 49k vocabulary's is for text in lower case.
PLAIN_WORD = re.compile("\0|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\0\x20\x09-\x0da-z0-9\xdf-\xf6\xf8-\xff]+")
PLAIN_SPACED = re.compile("\0|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[^\0\x20\x09-\x0dA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[\x20\x09-\x0d]+(?![^\0\x20\x09-\x0d])|[\x20\x09-\x0d]+")

#: Bytes that byte-level vocabularies don't write as the character of the same number; they take those from 256 on.
_UNSEEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
#: By a byte's number, the symbol that stands for it.
SYMBOL = "".join(chr(256 + _UNSEEN.index(b)) if b in _UNSEEN else chr(b) for b in range(256))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """What make() gives for the keys that were asked for lately.

    Two generations of up to half of most_bytes: when the younger is full it becomes the older one, and a key that is
    asked for again moves to the younger, so frequent keys are not made anew.
    """

    def __init__(self, make: Callable[[list], Iterable[bytes]], most_bytes: int):
        self.make, self.half, self.young, self.old, self.size = make, most_bytes // 2, {}, {}, 0

    def values(self, keys: list) -> list[bytes]:
        """The values of keys, which must differ."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        missing = [k for k, v in zip(keys, found, strict=True) if v is None]
        fresh = list(map(self.old.get, missing))
        made = iter(self.make([k for k, v in zip(missing, fresh, strict=True) if v is None]))
        fresh = [next(made) if v is None else v for v in fresh]
        self.size += ENTRY_BYTES * len(fresh) + sum(map(len, missing)) + sum(map(len, fresh))
        self.young.update(zip(missing, fresh, strict=True))
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        rest = iter(fresh)
        return [next(rest) if v is None else v for v in found]

    def joined(self, keys: pa.Array) -> tuple[bytes, np.ndarray]:
        """The joined values of keys, which may be repeated, and where each begins and the last ends; each distinct key is looked up once."""
        numbered = keys.dictionary_encode()
        values = pa.array(self.values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(numbered.indices)
        _, bounds, data = values.buffers()
        return data.to_pybytes() if data else b"", np.frombuffer(bounds, np.int64, len(values) + 1)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def sections(text: bytes) -> Iterable[bytes]:
    """text, cut where no token reaches across if it is long."""
    at = 0
    while len(text) - at > SECTION_BYTES and (m := CUT.search(text, at + SECTION_BYTES)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class WordEncoder:
    """Encodes texts as the tokenizers library does by the word vocabulary, without special tokens of its own.

    A text is cut at white space; unknown chunks are cut into words, and unknown words go through the model. Chunks beyond
    plain text are normalized and cut by the library, and those that may hold a special token go through it whole.
    """

    pattern = PLAIN_WORD

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.normalizer, self.pre_tokenizer = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        self.packed_ids = [packed([i]) for i in range(max(self.library.get_vocab().values(), default=-1) + 1)]
        self.chunks, self.words = Recent(self._new_chunks, most_bytes * 2 // 3), Recent(self._new_words, most_bytes // 3)

    def encode(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        """The ids of each text, with end after them."""
        if len(texts) > 1 and sum(map(len, texts)) > 4 * SECTION_BYTES:
            return self.encode(texts[: len(texts) // 2], end) + self.encode(texts[len(texts) // 2 :], end)
        if sum(map(len, texts)) > 4 * SECTION_BYTES:
            return [b"".join(chain.from_iterable(self._encode([part]) for part in sections(texts[0]))) + end]
        return self._encode(texts, end)

    def _encode(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        cut = self._cut(texts)
        ids, bounds = self.chunks.joined(cut.values)
        return [ids[a:b] + end for a, b in pairwise(bounds[cut.offsets.to_numpy()].tolist())]

    def _cut(self, texts: list[bytes]) -> pa.ListArray:
        """The chunks of each text, as bytes. An empty one stands for white space at an end."""
        return pc.ascii_split_whitespace(pa.array(texts, pa.string())).cast(pa.list_(pa.binary()))

    def _texts(self, chunks: list[bytes]) -> list[str]:
        return [c.decode() for c in chunks]

    def _new_chunks(self, chunks: list[bytes]) -> list[bytes]:
        texts = self._texts(chunks)
        fine = [t.isascii() and "<" not in t and t.isprintable() or "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        known = iter(self._plain(BETWEEN.join(compress(texts, fine))) if any(fine) else [])
        return [next(known) if f else self._special(t) if "<|" in t else self._odd(t) for f, t in zip(fine, texts, strict=True)]

    def _plain(self, text: str) -> list[bytes]:
        """ids of each of the chunks in plain text."""
        return self.words.joined(pa.array(self.pattern.findall(self._cased(text)), pa.string()))[0].split(MARK)

    def _cased(self, text: str) -> str:
        return text.lower()

    def _odd(self, text: str) -> bytes:
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        pieces = [piece.encode() for piece, _ in self.pre_tokenizer.pre_tokenize_str(normal)]
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.words.values(distinct), strict=True))
        return b"".join(map(ids.__getitem__, pieces))

    def _new_words(self, words: list[str | bytes]) -> list[bytes]:
        """Words of plain text are str; the library's pieces, whose characters stand for bytes already, are bytes."""
        return [MARK if w == BETWEEN else self._word(w.decode() if isinstance(w, bytes) else w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(SYMBOL)) for w in words]

    def _word(self, symbols: str) -> bytes:
        return b"".join([self.packed_ids[t.id] for t in self.model.tokenize(symbols)])

    def _special(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)


class SpacedEncoder(WordEncoder):
    """The same by the byte vocabulary, whose pre-tokens hold white space: a chunk is white space and a word.

    A chunk is kept without its space if that is all its white space, else with another one before it. Text with other
    than ASCII white space goes through the library in one piece.
    """

    pattern = PLAIN_SPACED

    def encode(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        whole = [not t.isascii() and OTHER_SPACE.search(t) is not None for t in texts]
        rest = iter(super().encode([t for t, w in zip(texts, whole, strict=True) if not w], end))
        return [self._special(t.decode()) + end if w else next(rest) for t, w in zip(texts, whole, strict=True)]

    def _cut(self, texts: list[bytes]) -> pa.ListArray:
        lists = list(map(self._chunks_of, texts))
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(chain.from_iterable(lists), pa.binary()))

    def _chunks_of(self, text: bytes) -> list[bytes]:
        if b"  " in text or text[-1:] == b" ":
            return [c[1:] if c[:1] == b" " and c[1:2] != b" " else b" " + c for c in CHUNK.findall(text)]
        first, *rest = text.split(b" ")
        return [b" " + first, *rest] if first else rest

    def _texts(self, chunks: list[bytes]) -> list[str]:
        return [(c[1:] if c[:1] == b" " else b" " + c).decode() for c in chunks]

    def _cased(self, text: str) -> str:
        return text


@held
def chunk_encoder(path: str, keep_space: bool, most_bytes: int | None = None) -> WordEncoder:
    """One encoder for all tasks of a Python worker: what is known stays known."""
    return SpacedEncoder(path, most_bytes or MOST_SPACED_BYTES) if keep_space else WordEncoder(path, most_bytes or MOST_BYTES)
