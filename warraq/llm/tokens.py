"""Token ids of whole texts by a public tokenizer file, in Arrow batches."""

from __future__ import annotations

import codecs
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 of white space outside ASCII begins with one of these.
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[*range(9, 14), *range(28, 33)]] = True
#: Marks that most often end a part.
MARKS = ".,:;!?"
#: Letters in every version of Unicode since 5.1, whichever a library knows.
SURE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0523\u05d0-\u05ea\u0621-\u063f\u0641-\u064a\u0904-\u0939\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fc3\uac00-\ud7a3"
SURE_LETTERS, SURE_TEXT = re.compile(f"[{SURE}]+").fullmatch, re.compile(f"[\x01-\x7f{SURE}]+").fullmatch
#: The byte-level pattern (a fixed value) over such letters and ASCII, where white space is that of Unicode, without the separators 28 to 31.
SPACE = "\t-\r "
SURE_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{SURE}]+| ?[0-9]+| ?[^{SPACE}{SURE}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def simple_parts(parts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Each part without the mark that ends it, if letters stand before it; whether there is such a mark; whether the rest is all letters."""
    trimmed = pc.utf8_rtrim(parts, characters=MARKS)
    one = pc.equal(pc.subtract(pc.binary_length(parts), pc.binary_length(trimmed)), 1)
    cut = pc.and_(one, pc.utf8_is_alpha(trimmed))
    return pc.if_else(cut, trimmed, parts), cut, pc.or_(cut, pc.utf8_is_alpha(parts))


def plain_texts(column: pa.Array, run) -> np.ndarray:
    """Which texts of a string column have white space only one at a time; ``run`` finds two together in a text."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = memoryview(raw)[ends[0] : ends[-1]] if raw is not None else memoryview(b"")
    whole = bytes(raw)
    if any(w in whole for w in WIDE_SPACE):
        return np.asarray([not run(t) for t in column.to_pylist()], bool)
    space = SPACE_BYTES[np.frombuffer(raw, np.uint8)]
    twice = np.flatnonzero(space[1:] & space[:-1]) + ends[0]
    out = np.ones(len(column), bool)
    # a pair may lie over two texts; then neither is cut, which is right as well
    out[np.minimum(np.searchsorted(ends, twice, side="right") - 1, len(column) - 1)] = False
    return out


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level files write the bytes: those printed in Latin-1 as they are, the others from 256 on in their order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


#: The character of each byte. Byte 0 stays, so that it can stand between words.
BYTE_TABLE = "".join(byte_characters().get(b, chr(b)) if b else "\0" for b in range(256))


def strings(column: pa.Array) -> list[str]:
    """A string column without nulls as a list: ``to_pylist`` makes an Arrow scalar of each first."""
    return column.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Encodes texts by a byte-level ``tokenizers`` file; the strings of special tokens are ordinary text.

    Texts in which white space comes one at a time are cut at their blanks and before
    their line feeds: a byte-level pattern goes on over no blank between two other
    characters, and takes a line feed there by itself, so the ids of a part do not
    depend on its neighbours. Each part that differs is then resolved once a batch,
    and the library meets only units that a bounded memo lacks. Other texts are
    encoded whole.
    """

    #: Whether the pattern lets texts be cut before line feeds.
    cut_lines = True

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.recent, self.older = most, {}, {}
        self.run = re.compile(r"\s\s").search
        #: Of the last call: the table's entries in order, and where each text's begin.
        self.used: tuple[np.ndarray, np.ndarray] | None = None
        self.mark_text = MARKS
        self.mark_ids = self._encode(list(MARKS))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _in_text(unit: str) -> str:
        """A unit after the blank that stands before it, unless a line feed does, which is the unit's own."""
        return unit if unit.startswith("\n") else " " + unit

    def _learn(self, units: list[str]) -> None:
        """Ids of each unit as it stands in texts (see ``_in_text``), into the memo.

        What the pattern takes for a word is beyond doubt in units of sure letters and
        ASCII characters: their words are encoded by the library's model one by one,
        but for a blank and a unit that the memo has. The library encodes all other
        units as texts.
        """
        recent, older = self.recent, self.older
        lone, mixed, rest = [], [], []
        for u in units:
            (lone if (u.isascii() and u.isalpha()) or SURE_LETTERS(u) else mixed if SURE_TEXT(u) else rest).append(u)
        recent.update(zip(lone, self._encode_words([" " + u for u in lone]), strict=True))
        words = [SURE_WORDS(self._in_text(u)) for u in mixed]
        ids = dict.fromkeys(w for some in words for w in some)
        for w in ids:
            if w[0] == " ":
                ids[w] = recent.get(w[1:]) or older.get(w[1:])
        new = [w for w, known in ids.items() if known is None]
        ids.update(zip(new, self._encode_words(new), strict=True))
        recent.update((u, b"".join([ids[w] for w in some])) for u, some in zip(mixed, words, strict=True))
        recent.update(zip(rest, self._encode(list(map(self._in_text, rest))), strict=True))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each of which the pattern leaves whole."""
        if not words:
            return []
        # no word holds the character 0, which is left as it is
        written = codecs.charmap_decode("\0".join(words).encode(), "strict", BYTE_TABLE)[0].split("\0")
        encode, flat, ends = self.tokenizer.model.tokenize, [], []
        for w in written:
            flat += [t.id for t in encode(w)]
            ends.append(4 * len(flat))
        raw = np.asarray(flat, "<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _resolve(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as it stands in texts; the units differ."""
        found = list(map(self.recent.get, units))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        for k in gaps:
            found[k] = self.older.get(units[k])
        if len(self.recent) + len(gaps) > self.most:
            self.older, self.recent = self.recent, {}
            self.recent.update((u, ids) for u, ids in zip(units, found, strict=True) if ids is not None)
        else:
            self.recent.update((units[k], found[k]) for k in gaps if found[k] is not None)
        gaps = [k for k in gaps if found[k] is None]
        self._learn([units[k] for k in gaps])
        for k in gaps:
            found[k] = self.recent[units[k]]
        return found

    def _units(self, parts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of units; the unit of each part; the number of the mark that ends it, or -1. A part is a unit, or letters and a mark."""
        unit, cut, _ = simple_parts(parts)
        coded = pc.dictionary_encode(unit)
        mark = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(parts, -1), pa.array(list(self.mark_text), parts.type)), -1)
        as_numbers = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int32)
        return self._resolve(strings(coded.dictionary)), as_numbers(coded.indices), np.where(cut.to_numpy(zero_copy_only=False), as_numbers(mark), np.int32(-1))

    def _plain(self, column: pa.Array) -> np.ndarray:
        return plain_texts(column, self.run)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts of a string column without nulls, and how many each text has."""
        plain = self._plain(column)
        cut = column if plain.all() else pc.if_else(pa.array(plain), column, pa.scalar("", column.type))
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n") if self.cut_lines else cut, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = lists.flatten()
        coded = pc.dictionary_encode(parts)
        units, unit, mark = self._units(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        # the first part of a text has no blank before it; a text that is not cut is a first part
        first = parts.take(pa.array(begins))
        first = first if plain.all() else pc.if_else(pa.array(plain), first, column)
        table = [*units, *self.mark_ids, *self._encode(strings(first))]
        index = coded.indices.to_numpy(zero_copy_only=False)
        entry, mark = unit[index], mark[index]
        entry[begins] = len(units) + len(self.mark_ids) + np.arange(len(begins))
        mark[begins] = -1
        # a part's unit is followed by its mark
        marked = mark >= 0
        place = np.arange(len(entry), dtype=np.int32) + np.cumsum(marked, dtype=np.int32) - marked
        entries = np.empty(len(entry) + int(marked.sum()), np.int32)
        entries[place] = entry
        entries[place[marked] + 1] = len(units) + mark[marked]
        begins = place[begins]
        self.used = entries, begins
        length = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        start = np.cumsum(length) - length
        size = length[entries]
        ends = np.cumsum(size)
        # places of ids; in 32 bits, which halves what is moved, unless there are too many
        kind = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        from_ = np.repeat((start[entries] - (ends - size)).astype(kind), size)
        from_ += np.arange(len(from_), dtype=kind)
        return flat.take(from_), np.add.reduceat(size, begins) if len(begins) else size


@lru_cache(maxsize=2)
def text_encoder(path: str, most: int = 200_000) -> TextEncoder:
    """One encoder for all tasks that a Python worker runs; its memo has up to twice ``most`` units (about 200 bytes each)."""
    return TextEncoder(path, most)


def vocabulary_size(path: str) -> int:
    """How many ids a file has."""
    return text_encoder(path).tokenizer.get_vocab_size()


def text_slices(column: pa.Array, most: int = 8 << 20):
    """(first row, slice) of a string column, each of about ``most`` bytes; a longer text has a slice of its own."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, column.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield begin, column.slice(begin)
