"""Encoding many texts with a tokenizer file by encoding each distinct piece once.

A space between two characters that aren't white space always begins a new piece for byte-level and
word-level pre-tokenizers: nothing before it can take it in, and it belongs to what follows (byte level) or
to nothing (word level). So a text may be cut before such spaces, and a piece has the same ids wherever it
stands. Texts whose spaces meet other white space are encoded whole. The distinct pieces of a batch are cut
into pre-tokens over all their bytes at once; only distinct pre-tokens that the bounded cache of the worker
process doesn't hold go through the model. Pieces with other characters than Latin letters, ASCII digits and
marks and single line ends are cut by the tokenizer's own rules.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens that a worker process remembers; when full, the cache starts anew.
CACHE_PIECES = 1_000_000
# Fixed value: white space of Unicode, as RE2 writes it.
SPACE_CLASS = r"[\p{Z}\x{9}-\x{D}\x{1C}-\x{1F}\x{85}]"

# A space in the public byte-level alphabet; kinds of characters of plain pieces.
LEAD = "\u0120"
ODD, LETTER, DIGIT, MARK, LINE = range(5)
# Plain pieces that a tokenizer must cut by kinds, or none of its pieces counts as plain.
PROBES = ["Word", "ab12Cd", "7", "ab,***", "(a-b)/c_d", "$$$", "Ab.\nCd", "12\n34", "\u00c9t\u00e9.", "Stra\u00dfe\n\u00c0", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, keeps_space: bool) -> "Encoder":
    """One Encoder a worker process; keeps_space: the space before a word is part of its token."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_space)
    return _encoders[key]


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each start s and length n, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + k for k, b in enumerate(rest)}


def _kinds(folds: bool) -> np.ndarray:
    """The kind of each byte of a plain piece. Lead bytes stand for U+00C0 to U+023F; to U+00FF where case is folded."""
    kinds = np.full(256, ODD, np.uint8)
    for b in range(33, 127):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    kinds[ord("\n")] = LINE
    # An apostrophe may begin a contraction and "<" an added token.
    kinds[[ord("'"), ord("<")]] = ODD
    kinds[0xC3 : 0xC4 if folds else 0xC9] = LETTER
    return kinds


class Encoder:
    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self._forget()
        self.table = _byte_letters()
        self.folds = self.tokenizer.normalizer is not None
        self.kinds = _kinds(self.folds)
        self.single_digits = len(self._split("12", "")) == 2
        self.follows_kinds = np.bool_(True)
        self.follows_kinds = np.bool_(all(self._agrees(x, lead) for x in PROBES for lead in (["", " "] if keeps_space else [""])))

    def _forget(self) -> None:
        """A pre-token's place: its ids end at ends[place] in the pool and begin where those before it end.

        words: by the character before them, bytes of pre-tokens of plain pieces and their places; known: other pre-tokens.
        """
        none = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.words = {"": none, LEAD: none}
        self.known: dict[str, int] = {}
        self.pool, self.ends = array("I"), array("q")

    def _agrees(self, piece: str, lead: str) -> bool:
        """Whether a plain piece is cut by the kinds of its characters as by the tokenizer's own rules."""
        parts, heads, _, plain = self._plain_parts(pa.array([piece], pa.large_string()))
        cut = [(LEAD if lead and head else "") + x.decode("latin-1").translate(self.table) for x, head in zip(parts.to_pylist(), heads)]
        return bool(plain[0]) and cut == self._split(piece, lead)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, piece: str, lead: str) -> list[str] | None:
        """The pre-tokens of a piece as the model takes them; None if it holds the text of an added token."""
        if "<|" in piece:
            return None
        whole = lead + piece
        if self.tokenizer.normalizer is not None:
            whole = self.tokenizer.normalizer.normalize_str(whole)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]

    def _add(self, ids: list[int]) -> int:
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        return len(self.ends) - 1

    def _places(self, parts: pa.Array, mark: str) -> np.ndarray:
        """The places of pre-tokens given by their bytes, mark standing before each; new ones go through the model."""
        coded = parts.dictionary_encode()
        words, (held, places) = coded.dictionary, self.words[mark]
        found = pc.index_in(words, value_set=held)
        new = np.asarray(found.is_null())
        at = np.zeros(len(words), np.int64)
        at[~new] = places[np.asarray(found.drop_null())]
        fresh = words.filter(pa.array(new))
        tokenize, table = self.tokenizer.model.tokenize, self.table
        texts = [mark + (x.decode() if x.isascii() and x != b"\n" else x.decode("latin-1").translate(table)) for x in fresh.to_numpy(zero_copy_only=False)]
        sizes = np.zeros(len(texts), np.int64)
        for k, x in enumerate(texts):
            ids = [y.id for y in tokenize(x)]
            self.pool.extend(ids)
            sizes[k] = len(ids)
        at[new] = len(self.ends) + np.arange(len(texts))
        self.ends.frombytes((len(self.pool) - sizes.sum() + np.cumsum(sizes)).tobytes())
        short = np.asarray(pc.binary_length(fresh)) <= 32
        self.words[mark] = pa.concat_arrays([held, fresh.filter(pa.array(short))]), np.concatenate([places, at[new][short]])
        return at[np.asarray(coded.indices)]

    def _plain_parts(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens of the plain pieces as bytes, whether each begins its piece, pre-tokens of each piece, whether a piece is plain)."""
        n = len(pieces)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + n + 1]
        data = pieces.buffers()[2]
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = self.kinds[text]
        # The second byte of a two-byte letter; those of the multiplication and division signs stay odd.
        second = np.flatnonzero((text[1:] & 0xC0 == 0x80) & (kind[:-1] == LETTER) & (text[:-1] >= 0xC3)) + 1
        second = second[(text[second - 1] != 0xC3) | ((text[second] != 0x97) & (text[second] != 0xB7))]
        kind[second] = LETTER
        if self.folds:
            upper = second[text[second] <= 0x9E]
            text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
            text[upper] += 0x20
        filled = np.diff(offsets) > 0
        begins = np.zeros(len(text) + 1, bool)
        begins[offsets[:-1][filled]] = True
        begins[-1] = True
        # A line end is a pre-token of its own between two characters that aren't white space.
        line = kind == LINE
        odd = (kind == ODD) | line & (begins[:-1] | begins[1:])
        odd[1:] |= line[1:] & line[:-1]
        upto = np.concatenate([[0], np.cumsum(odd)])
        plain = filled & (upto[offsets[1:]] == upto[offsets[:-1]]) & self.follows_kinds
        starts = begins[:-1].copy()
        starts[1:] |= kind[1:] != kind[:-1]
        if self.single_digits:
            starts |= kind == DIGIT
        at = np.flatnonzero(starts)
        owner = np.repeat(np.arange(n), np.diff(offsets))[at]
        kept = plain[owner]
        if self.folds:
            kept &= ~line[at]
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(text)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
        return parts.filter(pa.array(kept)), begins[:-1][at[kept]], np.bincount(owner[kept], minlength=n), plain

    def _pieces(self, pieces: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each), lead being the character before each.

        Plain pieces (Latin letters, ASCII digits and marks, single line ends) are cut where the kind of
        character changes, all at once; the others one by one by the tokenizer's own rules.
        """
        parts, heads, counts, plain = self._plain_parts(pieces)
        if lead:
            places = np.zeros(len(parts), np.int64)
            places[heads] = self._places(parts.filter(pa.array(heads)), LEAD)
            places[~heads] = self._places(parts.filter(pa.array(~heads)), "")
        else:
            places = self._places(parts, "")
        out: list[int] = []
        others = np.flatnonzero(~plain)
        for k, piece in zip(others.tolist(), pieces.take(pa.array(others)).to_numpy(zero_copy_only=False)):
            before, split = len(out), self._split(piece, lead)
            if split is None:
                out.append(self._add(self.tokenizer.encode(lead + piece, add_special_tokens=False).ids))
            else:
                for x in split:
                    at = self.known.get(x)
                    if at is None:
                        at = self._add([y.id for y in self.tokenizer.model.tokenize(x)])
                        if len(x) <= 32:
                            self.known[x] = at
                    out.append(at)
            counts[k] = len(out) - before
        first = np.zeros(len(counts), np.int64)
        first[plain] = np.cumsum(counts[plain]) - counts[plain]
        first[others] = len(places) + np.cumsum(counts[others]) - counts[others]
        which = ragged_take(np.concatenate([places, np.array(out, np.int64)]), first, counts)
        stops = np.frombuffer(self.ends, np.int64)
        starts = np.where(which > 0, stops[which - 1], 0) if len(which) else which
        sizes = stops[which] - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ragged_take(np.frombuffer(self.pool, np.uint32), starts, sizes), np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets with one entry more than texts); a null is an empty text."""
        if len(self.ends) > CACHE_PIECES:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        mixed = rf"^ | $|{SPACE_CLASS} | {SPACE_CLASS}" if self.keeps_space else None
        odd = np.asarray(pc.match_substring_regex(texts, mixed)) if mixed else np.zeros(n, bool)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = np.asarray(split.offsets)
        flat = split.flatten()
        base = offsets[0]
        offsets = offsets - base
        coded = flat.dictionary_encode()
        codes, found = np.asarray(coded.indices), coded.dictionary
        first = np.zeros(len(codes), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        values, lengths = self._pieces(found, " " if self.keeps_space else "")
        if self.keeps_space:
            heads, head_codes = np.unique(codes[first], return_inverse=True)
            more, more_lengths = self._pieces(found.take(pa.array(heads)), "")
            values, lengths = np.concatenate([values, more]), np.concatenate([lengths, more_lengths])
            codes = codes.copy()
            codes[first] = len(found) + head_codes
        starts = np.cumsum(lengths) - lengths
        out = ragged_take(values, starts[codes], lengths[codes])
        upto = np.concatenate([[0], np.cumsum(lengths[codes])])
        ends = upto[offsets]
        if odd.any():
            whole = dict(zip(np.flatnonzero(odd).tolist(), self._plain(texts.filter(pa.array(odd)).to_pylist())))
            parts = [whole.get(i, out[ends[i] : ends[i + 1]]) for i in range(n)]
            out = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return out.astype(np.uint32, copy=False), ends


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(ends) - 1
    return np.insert(ids, ends[1:], end_id).astype(np.uint32, copy=False), ends + np.arange(n + 1)


def small_batches(batches, column: str, max_bytes: int = 8_000_000):
    """Cuts record batches so that the texts of one weigh about max_bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
