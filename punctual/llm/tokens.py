"""Byte-level BPE ids of many texts: every distinct word is encoded once.

The tokenizer cuts a text into words before it merges bytes, and a space belongs to the
word after it. A word's ids therefore depend on the word alone, so a text is cut at its
spaces and line breaks, and the ids of each piece come from a bounded table of the pieces
seen so far. Texts with other white space, or with two such signs in a row, which these cuts
would divide differently, are encoded whole.

A letter and a mark such as a full stop always belong to different words, so texts are cut
there as well. When the table is full, the half of it that was used last stays.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex

#: Memory of the pieces remembered per Python worker.
TABLE_BYTES = 40 << 20
#: What a piece takes beside its letters and ids: a string, its place in the table, three numbers.
PIECE_BYTES = 190
#: White space inside a piece: its text is encoded whole.
BLANK = re.compile(r"\s")
#: A mark after a letter begins a word, and so a piece without a space before it.
MARKS = (r"(\pL)([.,;:!?]+)", "\\1 \r\\2")
#: How the tokenizer cuts a text into words.
WORDS = regex.compile(public_tokenizers.PATTERN)
#: Marks a piece that no space precedes. It is white space, so no other piece holds it.
BARE = "\r"


def _byte_letters() -> str:
    """The letter that stands for each byte: printable ones for themselves, the others
    for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(letters[b] for b in range(256))


class Tokens:
    """Ids of one vocabulary file of the byte-level kind."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.table_bytes = table_bytes
        # Place 0 stands for pieces whose ids only the whole text tells.
        self.places: dict[str, int] = {}
        self.flat, self.ends, self.used = array("I"), array("i", [0, 0]), array("i", [0])
        self.calls = 0

    def forget(self) -> None:
        """Keep the pieces used last, half of the table."""
        used = np.array(self.used)
        sizes = np.diff(np.array(self.ends))
        order = np.argsort(-used, kind="stable")
        keep = np.zeros(len(used), bool)
        keep[order[np.cumsum(PIECE_BYTES + 4 * sizes[order]) <= self.table_bytes // 2]] = True
        keep[0] = True
        flat = np.array(self.flat)[np.repeat(keep, sizes)]
        new = np.cumsum(keep) - 1
        kept, new = keep.tolist(), new.tolist()
        self.places = {piece: new[place] for piece, place in self.places.items() if place and kept[place]}
        self.flat, self.used = array("I", flat.tobytes()), array("i", used[keep].tobytes())
        self.ends = array("i", np.append(0, np.cumsum(sizes[keep])).astype(np.int32).tobytes())

    @property
    def largest(self) -> int:
        """The largest id there is."""
        return self.tokenizer.get_vocab_size(with_added_tokens=True) - 1

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def merged(self, word: str) -> list[int]:
        rest = word.removeprefix(" ")
        if rest.isascii() and rest.isprintable():
            shown = self.space + rest if len(rest) < len(word) else rest
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return [part.id for part in self.merge(shown)]

    def add(self, piece: str, ids: list[int] | array) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.used.append(self.calls)
        place = self.places[piece] = len(self.used) - 1
        return place

    def learn(self, piece: str) -> int:
        """The place of a new piece, or 0 where only the whole text tells its ids."""
        if piece.isalpha():
            return self.add(piece, self.merged(" " + piece))
        bare = piece[:1] == BARE
        if piece != "\n" and (len(piece) == bare or BLANK.search(piece, bare)):
            self.places[piece] = 0
            return 0
        text = piece[1:] if bare else piece if piece == "\n" else " " + piece
        words = WORDS.findall(text)
        if len(words) == 1:
            return self.add(piece, self.merged(text))
        ids = array("I")
        for word in words:
            key = word[1:] if word[0] == " " else BARE + word
            place = self.places[key] if key in self.places else self.learn(key)
            ids += self.flat[self.ends[place] : self.ends[place + 1]]
        return self.add(piece, ids)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the texts' pieces one after the other, each text's first piece, and which
        texts only the tokenizer itself can encode."""
        if PIECE_BYTES * len(self.places) + 4 * len(self.flat) > self.table_bytes:
            self.forget()
        self.calls += 1
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n " + BARE), *MARKS)
        lists = pc.split_pattern(pc.binary_join_element_wise(BARE, marked, ""), " ")
        pieces = lists.flatten().dictionary_encode()
        known, learn = self.places, self.learn
        places = np.array(
            [p if (p := known.get(piece)) is not None else learn(piece) for piece in pieces.dictionary.to_pylist()],
            np.int32,
        )
        np.frombuffer(self.used, np.int32)[places] = self.calls
        places = places[pieces.indices.to_numpy()]
        firsts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        whole = pc.match_substring(texts, BARE).to_numpy(zero_copy_only=False)
        if len(texts):
            whole = whole | np.logical_or.reduceat(np.append(places == 0, False), firsts[:-1])
        return places, firsts, whole

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with ``end`` after it, and the number of
        ids of each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        places, firsts, whole = self._places(texts)
        ends = np.frombuffer(self.ends, np.int32)
        starts = ends[places]
        sizes = ends[places + 1] - starts
        done = np.cumsum(sizes, dtype=np.int32)
        gather = np.repeat(starts - (done - sizes), sizes)
        gather += np.arange(len(gather), dtype=np.int32)
        ids = np.frombuffer(self.flat, np.uint32)[gather]
        bounds = np.append(np.int32(0), done)[firsts].tolist()
        out, lengths = [], np.empty(len(texts), np.int64)
        last = np.array([end], np.uint32)
        for i in range(len(texts)):
            own = np.array(self.whole(texts[i].as_py()), np.uint32) if whole[i] else ids[bounds[i] : bounds[i + 1]]
            out += [own, last]
            lengths[i] = len(own) + 1
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), lengths

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text (null: none), without the ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        places, firsts, whole = self._places(texts)
        sizes = np.diff(np.frombuffer(self.ends, np.int32)).astype(np.int64)[places]
        counts = np.diff(np.append(0, np.cumsum(sizes))[firsts])
        for i in np.flatnonzero(whole):
            counts[i] = len(self.whole(texts[int(i)].as_py()))
        return counts


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One table of pieces for each Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]
