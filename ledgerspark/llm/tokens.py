"""Token ids of whole texts by the tokenizers library, a batch of texts at a time.

Both vocabularies split a text before any merge, and no such split part reaches over the
places where Pieces cuts; so the ids of the parts, set side by side, are the ids of the text
(tests/llm compares them with whole encodings). A batch's bytes are one Arrow column of parts,
made distinct by Arrow; only distinct parts are looked up or go to the library, and the ids
of all are gathered from theirs.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Parts remembered by a worker at most, in each of two generations, and the bytes of one.
REMEMBERED, LONGEST = 350_000, 128
_KEPT: dict = {}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that are no white space (those of C2, E1, E2 and E3 may be).
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[list(b".,!?;:*#$%&|)")] = True
#: Parts of nothing but a-z and U+00DF to U+00FF (no division sign): no step before the merges changes or splits them.
_SMALL = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+").fullmatch


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and len(texts) + 1 places between them."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]


class Pieces:
    """encode(texts) gives the ids of all texts one after another, and len(texts) + 1 places between them.

    Special tokens' strings inside a text get their special ids, as the library has it unless told
    otherwise; with `plain` they are ordinary text.
    """

    #: Whether white space is left out of the parts, for it has no ids.
    dense = False
    #: For a vocabulary that marks the ends of words: a tokenizer of small letters alone, and which ids are ends.
    small = ends = None

    def __init__(self, path: str, kind: str, plain: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.cut = {"byte": self._cut_byte, "word": self._cut_word}[kind]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if kind == "word":
            vocabulary = self.tokenizer.get_vocab()
            self.dense, self.ends = True, np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
            self.small = Tokenizer(self.tokenizer.model)
            self.small.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])

    @staticmethod
    def _cut_byte(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts before a single space that a non-space follows (it belongs to the next part), and between a letter and a sign."""
        begins = np.zeros(len(data), bool)
        begins[:-1] = (data[:-1] == 32) & _SOLID[data[1:]]
        begins[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
        return data, begins

    @staticmethod
    def _cut_word(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts before each word, and between a letter and a sign; A-Z in lower case as the vocabulary has them."""
        begins, blank = np.zeros(len(data), bool), _BLANK[data]
        begins[1:] = blank[:-1] & ~blank[1:] | _LETTER[data[:-1]] & _SIGN[data[1:]]
        return np.where((data >= 65) & (data <= 90), data | 32, data), begins

    def _special_places(self, data: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Where the special strings stand; none reaches over the end of a text."""
        raw, found = data.tobytes() if self.special else b"", []
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                if edges[np.searchsorted(edges, at, side="right")] >= at + len(x):
                    found.append((at, at + len(x)))
                at = raw.find(x, at + 1)
        return found

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts that aren't known yet, little-endian unsigned 32-bit."""
        out = [b""] * len(parts)
        small = [i for i, x in enumerate(parts) if _SMALL(x)] if self.small is not None else []
        if small:  # one text of words, its ids cut behind each end of a word
            ids = np.array(self.small.encode_batch_fast([b" ".join([parts[i] for i in small]).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, low = ids.tobytes(), 0
            for i, high in zip(small, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                out[i], low = raw[low:high], high
        rest = [i for i, x in enumerate(out) if not x]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        missing = []
        for i, x in enumerate(found):
            if x is None:
                if (again := old.get(parts[i])) is not None:
                    young[parts[i]] = found[i] = again
                else:
                    missing.append(i)
        for i, ids in zip(missing, self._learn([parts[i] for i in missing]) if missing else [], strict=True):
            found[i] = ids
            if len(parts[i]) <= LONGEST:
                young[parts[i]] = found[i]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, edges = flat(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        special, solid = self._special_places(data, edges), ~_BLANK[data] if self.dense else None
        data, begins = self.cut(data)
        if self.dense:  # here a place's cut depends on nothing behind it
            place = np.concatenate(([0], np.cumsum(solid)))
            data, begins, edges, special = data[solid], begins[solid], place[edges], [(int(place[a]), int(place[b])) for a, b in special]
            if not len(data):
                return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        some = edges[:-1] < edges[1:]
        if not self.dense:
            begins[edges[1:][some] - 1] = False  # what stands in the next text doesn't matter
        for a, b in special:  # nor what stands on the other side of a special string
            begins[a if self.dense else max(a - 1, 0) : b] = False
        begins[edges[:-1][some]] = True
        for a, b in special:
            begins[a] = True
            begins[b : b + 1] = True
        bounds = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known, which = self._ids(parts.dictionary.to_pylist()), parts.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        firsts, table = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        n = sizes[which]
        ends = np.cumsum(n)
        ids = table[np.arange(ends[-1]) + np.repeat(firsts[which] - (ends - n), n)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(bounds, edges)]

    def encode_with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode with end_id after each text."""
        ids, edges = self.encode(texts)
        return np.insert(ids, edges[1:], end_id).astype("<u4", copy=False), edges + np.arange(len(edges))


class Sentences(Pieces):
    """The same by a sentencepiece model that puts a space before each text: texts come with that space.

    No entry of such a model has a space after anything but spaces (checked), so a text can be cut
    before each run of spaces. A part whose ids don't give back its bytes has the one id `unlike`.
    """

    unlike = 2**32 - 1

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        assert not any("\u2581" in x.lstrip("\u2581") for x in names), "an entry of the model reaches over a space"
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)]
        self.space = self.model.piece_to_id("\u2581")
        self.special, self.young, self.old = [], {}, {}

    @staticmethod
    def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        return data, begins

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        told = self.model.encode([x[1:].decode() for x in parts], num_threads=1)
        out = []
        for part, ids in zip(parts, told, strict=True):
            ids = ids if part != b" " else [self.space]
            out.append(array("I", ids if b"".join(map(self.bytes.__getitem__, ids)) == part else [self.unlike]).tobytes())
        return out


def kept(key: tuple, make):
    """What make() gives, once for each worker process and key, kept between tasks."""
    if key not in _KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _KEPT[key] = make()
    return _KEPT[key]


def pieces(path: str, kind: str, plain: bool = False) -> Pieces:
    return kept((path, kind, plain), lambda: Pieces(path, kind, plain))


def groups(batch: pa.RecordBatch, column: int, most: int = 6_000_000):
    """Slices of a batch in which a text column has about so many bytes, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values' bytes from each edge to the next, as an Arrow column."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def shards_of(docs: DataFrame, docs_per_shard: int, least: int = 1024) -> int:
    """Shards of about docs_per_shard documents; of fewer (`least`, or docs_per_shard if that is less) where cores would idle."""
    n = docs.count()
    return max(1, -(-n // docs_per_shard), min(-(-n // min(least, docs_per_shard)), 2 * docs.sparkSession.sparkContext.defaultParallelism))
