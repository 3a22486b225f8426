"""Encoding of whole texts by the tokenizers library, one distinct word at a time.

Running a tokenizer over every text repeats the same merges for the same words
over and over.  No pre-token of these tokenizers contains a space that stands
between two visible characters (it only begins with it), so a text may be cut
at those spaces, each distinct word encoded once by the library's own
pre-tokenizer and BPE model, and the text's ids put together from those.  Arrow
splits the texts of a slice and looks their words up in a table that a worker
keeps from slice to slice, so only words that are new to it pass through Python;
a text's ids are gathered from the table's in one go.  When the table has more
than ``MAX_WORDS`` words or ``MAX_WORD_BYTES``, the words of the last slice are
kept.  Pre-tokens already met are kept in two generations of at most
``max_pieces``: when the young one is full it becomes the old one, and those met
again move up.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cut before a space with a visible character on either side: the general rule.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A space for which plain splitting would break a run of white space.
_RUN = re.compile(r"(?<!\S) (?!\S)|\A ")
#: Arrow finds what a text with such a space must have, one after white space (as
#: ``\s`` of Python has it) or at the beginning, in a fraction of the time.
_MAY_RUN = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |\A ")
#: Letters whose class, lower case and normal form are the same in all libraries;
#: ASCII punctuation but the apostrophe, which can begin a contraction; and a
#: line feed that is no part of a run of white space.  A word that consists of
#: runs of these has them as its pre-tokens, no need to ask the library.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}{_SIGNS}](?:[{_LETTERS}{_SIGNS}]|\n(?!\s))*")
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_SIGNS}]+|\n")

MAX_PIECES = 80_000
MAX_PIECE_CHARS = 64
MAX_WORDS, MAX_WORD_BYTES = 400_000, 16_000_000
SLICE_BYTES = 3_000_000
ID_TYPE = np.dtype("<u4")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(MAX_PIECE_CHARS)]


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself
    if it is visible Latin-1, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class _Recent(dict):
    """A bounded table: string -> ids as bytes, made by ``make`` on first use."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= MAX_PIECE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _Words:
    """Words and their ids: an Arrow array beside one array of all ids."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, ID_TYPE), np.zeros(0, np.int64)

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), ID_TYPE)])
        self.sizes = np.concatenate([self.sizes, _sizes(ids)])

    def keep(self, used: np.ndarray) -> None:
        """Forget all but the words numbered ``used``, if there are too many."""
        if len(self.words) > MAX_WORDS or self.words.nbytes > MAX_WORD_BYTES:
            used = np.unique(used)
            self.ids = gathered(self.ids, self.sizes, used)
            self.words, self.sizes = self.words.take(pa.array(used)), self.sizes[used]


def _sizes(ids: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids)) // ID_TYPE.itemsize


def gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words numbered ``at``, in a row; ``ids`` has those of all
    words, ``sizes`` how many each has."""
    starts, some = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(some)
    n = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts[at] - ends + some, some) + np.arange(n)]


class WordEncoder:
    """``tokenizer``: a byte-level tokenizers.Tokenizer.  ``drops_space``: its
    pre-tokenizer removes white space and folds case, so words stand alone;
    otherwise every word but a text's first begins with its space.

    ``added_tokens``: the tokenizer's added tokens are matched in the texts, as
    the library does by default, and what stands between them is encoded by
    itself; otherwise they are ordinary text."""

    def __init__(self, tokenizer, drops_space: bool = False, max_pieces: int = MAX_PIECES,
                 added_tokens: bool = False):
        self.added, self.added_ids = None, {}
        if added_tokens:
            added = tokenizer.get_added_tokens_decoder()
            if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
                raise ValueError("added tokens must be matched as they stand in the text")
            self.added_ids = {t.content: i for i, t in added.items()}
            # of tokens that begin at one place the longest is matched
            names = sorted(self.added_ids, key=len, reverse=True)
            if names:
                self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")")
        tokenizer.encode_special_tokens = True  # to the model they are ordinary text
        self.drops_space = drops_space
        self.model, self.splitter = tokenizer.model, tokenizer.pre_tokenizer
        self.normalizer = tokenizer.normalizer
        self.bytes_to_chars = str.maketrans(
            {chr(b): c for b, c in enumerate(byte_characters())})
        self.before = "" if drops_space else byte_characters()[ord(" ")]
        self.pieces = _Recent(self._encode_piece, max_pieces)
        self.known = _Words()

    def _encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, written in byte characters."""
        ids = [t.id for t in self.model.tokenize(piece)]
        return (_PACK[len(ids)] if len(ids) < len(_PACK) else
                struct.Struct(f"<{len(ids)}I").pack)(*ids)

    def _encode_word(self, word: str, before: str) -> bytes:
        """Ids of a word and of the space ``before`` it (in byte characters)."""
        if word.isascii() and word.isalpha():
            return self.pieces[word.lower() if self.drops_space else before + word]
        if _PLAIN.fullmatch(word):
            parts = _PARTS.findall(word.lower() if self.drops_space else word)
            if not word.isascii() or "\n" in word:
                parts = [p.encode().decode("latin-1").translate(self.bytes_to_chars)
                         for p in parts]
            parts[0] = before + parts[0]
            return b"".join([self.pieces[p] for p in parts])
        if not word:
            return self.pieces[before] if before else b""
        word = (" " if before else "") + word
        if self.normalizer is not None:
            word = self.normalizer.normalize_str(word)
        return b"".join([self.pieces[p] for p, _ in self.splitter.pre_tokenize_str(word)])

    def _encode_runs(self, text: str) -> bytes:
        """A text in which some spaces belong to a run of white space."""
        head, *words = _CUT.split(text)
        return self._encode_word(head, "") + b"".join(
            [self._encode_word(w[1:], self.before) for w in words])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        if any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added_ids):
            return self._encode_around_added(texts)
        return self._encode_plain(texts)

    def _encode_around_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        between, ids_of, after, last = [], [], [], []
        for text in texts.to_pylist():
            segments = self.added.split(text)  # text, token, text, ..., text
            ids_of += [self.added_ids[t] for t in segments[1::2]]
            after += range(len(between), len(between) + len(segments) // 2)
            between += segments[::2]
            last.append(len(between) - 1)
        ids, ends = self._encode_plain(pa.array(between, pa.large_string()))
        after = np.array(after, np.int64)
        last = np.array(last, np.int64)
        return (np.insert(ids, ends[after], np.array(ids_of, ID_TYPE)),
                ends[last] + np.searchsorted(after, last))

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        heads = []  # ids of what stands before the first cut
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            may_run = pc.match_substring_regex(texts, _MAY_RUN).to_pylist()
            rest = []
            for text, may in zip(texts.to_pylist(), may_run):
                if may and _RUN.search(text):
                    heads.append(self._encode_runs(text))
                    rest.append("")
                else:
                    heads.append(self._encode_word(text.partition(" ")[0], ""))
                    rest.append(text)
            texts = pa.array(rest, pa.large_string())
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy())
        place = pc.index_in(words, value_set=self.known.words)
        new = words.filter(pc.is_null(place)).dictionary_encode()
        at = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known.words) + new.indices.to_numpy()
        before = self.before
        self.known.add(new.dictionary, [self._encode_word(w, before)
                                        for w in new.dictionary.to_pylist()])
        ids, sizes, used = self.known.ids, self.known.sizes, at
        if heads:
            at = at.copy()
            at[np.concatenate([[0], ends[:-1]])] = len(sizes) + np.arange(len(heads))
            ids = np.concatenate([ids, np.frombuffer(b"".join(heads), ID_TYPE)])
            sizes = np.concatenate([sizes, _sizes(heads)])
        placed = np.concatenate([[0], np.cumsum(sizes[at])])
        out = gathered(ids, sizes, at)
        self.known.keep(used)
        return out, placed[ends]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.large_string()))[0]

    def encode_column(self, batch: pa.RecordBatch, column: str = "text"):
        """Slices of a batch with the ids of their texts."""
        for part in text_slices(batch, column):
            yield part, *self.encode_batch(part.column(column))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Slices of a batch whose texts have at most ``most`` bytes (or one text)."""
    sizes = pc.binary_length(batch.column(column)).to_numpy()
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), most, "right")))
        yield batch.slice(at, n)
        at += n


_encoders: dict[tuple, WordEncoder] = {}


def word_encoder(path: str, drops_space: bool = False, added_tokens: bool = False) -> WordEncoder:
    """The encoder of a tokenizer file, kept for the life of a Python worker."""
    key = (path, drops_space, added_tokens)
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _encoders[key] = WordEncoder(Tokenizer.from_file(path), drops_space,
                                     added_tokens=added_tokens)
    return _encoders[key]
