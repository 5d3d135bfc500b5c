"""Byte-level BPE encoding of whole texts inside Spark tasks, with the tokenizers library.

A text is cut at single spaces that stand between two non-space characters; the pre-tokenizer never joins
across such a place, so the pieces' ids, each piece with its leading space, concatenate to the text's ids.
Pieces repeat, so each worker keeps a bounded memo of their ids.
"""

from __future__ import annotations

import os
import re
import struct

#: Pieces a worker remembers, and the longest piece it remembers. They are kept in two halves: when the newer one is
#: full it becomes the older one, and pieces met again move back to the newer.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 40
#: Characters encoded in one call of the library.
CALL_CHARS = 200_000
#: Marks that may follow a word in a piece.
MARKS = ".,;:!?*#$%&|"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_encoders: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(text: str) -> list[str]:
    """Pieces of a text, each but the first without the space before it."""
    parts = text.split(" ")
    lone = "" not in parts and " \n" not in text and "\n " not in text and text[0] != "\n" and text[-1] != "\n"
    if lone and not _OTHER_SPACE.search(text):
        return parts
    out = [parts[0]]
    open_end = not parts[0] or parts[0][-1].isspace()
    for p in parts[1:]:
        if open_end or not p or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
        open_end = not p or p[-1].isspace()
    return out


class _Memo(dict):
    """Ids of pieces after a space; those not known are asked of the encoder."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.learn(piece)


class Encoder:
    """Ids of texts as little-endian unsigned integers of 16 bits if the vocabulary has no more ids, else of 32 (`kind`)."""

    def __init__(self, vocabulary: str, plain_specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        # byte-level BPE names each byte by a printable character: the printable Latin-1 ones stand for themselves
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = iter(range(256, 512))
        self.names = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
        self.space = self.names[32]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.packers = [struct.Struct(f"<{n}{self.code}").pack for n in range(64)]
        self.line = self._library("\n")
        self.memo, self.older = _Memo(self), {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def _ids(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _library(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of letters, after a space or not, which the pre-tokenizer keeps whole."""
        name = word if word.isascii() else "".join([self.names[b] for b in word.encode()])
        return self._ids([t.id for t in self.model.tokenize(lead + name)])

    def learn(self, piece: str) -> bytes:
        """Ids of a piece after a space or, if it begins with one, a line break; remembered if it is short."""
        memo, ids = self.memo, self.older.get(piece)
        if ids is None:
            if "\n" in piece[1:]:
                lines = piece.split("\n")
                if lines == piece.split():  # single line breaks, each a token of its own
                    return memo[lines[0]] + b"".join([memo["\n" + x] for x in lines[1:]])
            word = piece.rstrip(MARKS)
            bare = word[1:] if word[:1] == "\n" else word
            if not bare.isalpha():
                ids = self._library(piece if piece[:1] == "\n" else " " + piece) if piece else b""
            else:
                ids = memo.get(word) or self.older.get(word)
                if ids is None:
                    ids = self._word(self.space, word) if bare is word else self.line + self._word("", bare)
                if len(word) < len(piece):
                    if len(word) <= MEMO_CHARS:
                        memo[word] = ids
                    tail = piece[len(word) :]
                    mark = self.marks.get(tail)
                    if mark is None:
                        mark = self._library(tail)
                        if len(self.marks) < MEMO_PIECES // 8 and len(tail) <= MEMO_CHARS:
                            self.marks[tail] = mark
                    ids += mark
        if len(piece) <= MEMO_CHARS:
            memo[piece] = ids
        return ids

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if len(self.memo) > MEMO_PIECES // 2:
            self.older, self.memo = self.memo, _Memo(self)
        cut = [pieces_of(t) for t in texts]
        firsts = [c[0] for c in cut]
        names = sorted(set(firsts))
        first = {p: self._ids(e.ids) for p, e in zip(names, self.tokenizer.encode_batch(names, add_special_tokens=False))}
        for c in cut:
            c[0] = ""  # the first piece is joined by hand
        find = self.memo.__getitem__
        return [first[f] + b"".join(map(find, c)) for f, c in zip(firsts, cut)]


def encoder(vocabulary: str = "byte_bpe_50k.json", plain_specials: bool = False) -> Encoder:
    """This worker's encoder."""
    key = (vocabulary, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def in_groups(rows, size, most: int = CALL_CHARS):
    """Lists of consecutive rows of about `most` in total size."""
    group, total = [], 0
    for r in rows:
        group.append(r)
        total += size(r)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group
