"""Token ids of whole texts by the tokenizers library, with the ids of space-delimited parts kept for reuse.

A byte-level vocabulary splits a text before any pre-token that begins with a space, so the ids of a text are
the ids of its parts, each part with the space before it, one after the other. This holds where the space
is part of no longer run of white space that the splitting pattern takes as one; a text with such a run is
cut only at single spaces. A vocabulary that drops white space may be cut at any space.

A part of EASY characters is split into pre-tokens here, by the vocabulary's own pattern over these
characters; each pre-token goes to the library's model. Any other part, and any text that holds the string of a special
token, goes to the library as it is. So ids equal those of the library's plain call.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

from voxweave.llm.arrow import keep

#: Parts in a generation of a worker's cache, of which there are two, and the longest part that is kept.
KEPT_PARTS, KEPT_LENGTH = 300_000, 64
#: Characters, and texts, whose parts are gathered at once.
CHARS, STRINGS = 4_000_000, 10_000
#: A run of white space that a cut at a space might split.
ODD_SPACE = re.compile(r"\s\s(?:\s|\Z)")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Letters beside A-Z that have one code point, one lower case, and no mark to compose with.
LETTERS = "À-ÖØ-öø-įı-ſЀ-ҁҊ-ӿ"
EASY = re.compile(rf"[\t-\r!-~{LETTERS}]*\Z")
#: Characters of which lower case may be taken before the library composes marks.
FOLDABLE = re.compile(rf"[\x00-\x7f{LETTERS} -©«-´¶-¹»-¿×÷‐-‧、-〩ぁ-ゖァ-ヺ一-龥가-힣]*\Z")
#: How the two kinds of vocabulary split, over EASY characters.
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LETTERS}]+| ?[0-9]+| ?[^\sA-Za-z0-9{LETTERS}]+|\s+(?!\S)|\s+")
UNSPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\sa-z0-9{LETTERS}]+")

#: A word and the marks after it, two pre-tokens in either kind.
WORD_AND_MARKS = re.compile(rf"([A-Za-z{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)\Z")

#: How byte-level vocabularies spell bytes: printable ones as themselves, the others in order from U+0100.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_encoders: dict[tuple[str, int], "PartEncoder"] = {}


class PartEncoder:
    """Encodes texts to unsigned 32-bit ids (little-endian, as on all machines that Spark's Arrow transfer supports), adding no special tokens.

    Texts are cut at spaces by Arrow, some megabytes at a time; each different part is looked up once, or encoded if it
    is new, and the ids of all parts are gathered by numpy.

    folds: the vocabulary is of lower case and drops white space, so that a part's case, and the space before
    it, make no difference to its ids.
    """

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        model = json.loads(self.tokenizer.to_str())
        self.special = re.compile("|".join(re.escape(x["content"]) for x in model["added_tokens"]) or r"(?!)")
        self.folds = "Lowercase" in json.dumps(model["normalizer"]) and model["model"]["end_of_word_suffix"] == "</w>"
        self.before, self.spelled_before = ("", "") if self.folds else (" ", " ".translate(SPELLED))
        self.pattern = UNSPACED if self.folds else SPACED
        self.tokenize = self.tokenizer.model.tokenize
        self.forget()

    def forget(self) -> None:
        #: Ids of parts with the space before them, and of pre-tokens as they are: of this generation, and of the one before.
        self.parts, self.old_parts, self.pieces, self.old_pieces = {}, {}, {}, {}

    def _next_generation(self) -> None:
        if len(self.parts) > self.kept:
            self.parts, self.old_parts = {}, self.parts
        if len(self.pieces) > self.kept:
            self.pieces, self.old_pieces = {}, self.pieces

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a pre-token of EASY characters and spaces."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old_pieces.get(piece)
            if ids is None:
                spelled = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(SPELLED)
                ids = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
            if len(piece) <= KEPT_LENGTH:
                self.pieces[piece] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """The ids of a part with the space before it."""
        ids = self.parts.get(part)
        return ids if ids is not None else self._new(part)

    def _new(self, part: str) -> bytes:
        """The ids of a part that this generation does not know, kept for the next time."""
        ids = self.old_parts.get(part)
        if ids is None:
            found = WORD_AND_MARKS.match(part)
            if not found or self.folds and not part.islower():
                ids = self._odd_part(part)
            elif marks := found[2]:
                ids = self._part(found[1]) + (self.pieces.get(marks) or self._piece(marks))
            else:
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(SPELLED)
                ids = array("I", [t.id for t in self.tokenize(self.spelled_before + spelled)]).tobytes()
        if len(part) <= KEPT_LENGTH and "\n" not in part:
            self.parts[part] = ids
        return ids

    def _odd_part(self, part: str) -> bytes:
        """The ids of a part with the space before it, for a part that is more than a word and marks."""
        if not EASY.match(part):
            return self._whole(self.before + part)
        if self.folds:
            part = part.lower()
        first, *more = self.pattern.findall(self.before + part) or [""]
        word = first[len(self.before) :]
        if not more or not word.isalpha():
            return b"".join(map(self._piece, (first, *more) if first else ()))
        return b"".join((self._part(word), *map(self._piece, more)))

    def _head(self, part: str) -> bytes:
        """The ids of a part without a space before it."""
        return b"".join(map(self._piece, self.pattern.findall(part))) if EASY.match(part) else self._whole(part)

    def _started(self, text: str) -> tuple[bytes, str | None]:
        """The ids of what comes before the text's first space, and the parts after it as one string, if there are any."""
        if self.special.search(text):
            return self._whole(text), None
        if self.folds:
            return b"", text.lower() if text.isascii() or FOLDABLE.match(text) else text
        if ODD_SPACE.search(text):
            head, *parts = SINGLE_SPACE.split(text)
            return b"".join((self._head(head) if head[:1] != " " else self._whole(head), *map(self._part, parts))), None
        head, space, rest = text.partition(" ")
        return self._head(head), rest if space else None

    def _gathered(self, texts: list[str | None]) -> list[bytes]:
        """The ids of strings of parts; null has none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self._next_generation()
        split = pc.split_pattern(pa.array(texts, pa.string()), pattern=" ")
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        parts = split.flatten()
        if not len(parts):
            return [b""] * len(texts)
        coded = parts.dictionary_encode()
        different = coded.dictionary
        # parts have no space in them
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), " ")[0].as_py().split(" ")
        ids = list(map(self.parts.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        before = list(map(self.old_parts.get, map(words.__getitem__, missing)))
        self.parts.update((words[k], x) for k, x in zip(missing, before, strict=True) if x is not None)
        for k, x in zip(missing, before, strict=True):
            ids[k] = x if x is not None else self._new(words[k])
        lengths = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        each = lengths[at]
        ends = np.cumsum(each)
        place = np.repeat(starts[at] - (ends - each), each)
        place += np.arange(len(place))
        found = flat[place]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_all(texts))

    def encode_all(self, texts, chars: int | None = None) -> Iterator[bytes]:
        """The ids of each text, or Arrow string, one by one; null counts as empty. A long text is cut at spaces, and its ids are joined again.

        chars: characters whose parts are gathered at once, CHARS if none are given; fewer take less memory.
        """
        chars = chars or CHARS
        waiting: list[tuple[bytes, int]] = []  # of each text the ids of its beginning, and the strings of parts that follow
        strings: list[str | None] = []
        size = 0

        def done():
            found = iter(self._gathered(strings))
            for head, n in waiting:
                yield b"".join((head, *islice(found, n)))
            waiting.clear(), strings.clear()

        for text in texts:
            head, rest = self._started((text if isinstance(text, str) or text is None else text.as_py()) or "")
            if rest is not None and len(rest) > chars:
                yield from done()
                size, at, found = 0, 0, [head]
                while at is not None:
                    end = rest.find(" ", at + chars)
                    found += self._gathered([rest[at : end if end >= 0 else None]])
                    at = end + 1 if end >= 0 else None
                yield b"".join(found)
                continue
            waiting.append((head, 1))
            strings.append(rest)
            size += len(rest or "")
            if size >= chars or len(strings) >= STRINGS:
                yield from done()
                size = 0
        yield from done()


def encoder(path: str, kept: int = KEPT_PARTS) -> PartEncoder:
    """One encoder per Python worker and vocabulary; what it keeps goes when the worker begins a stage of another kind."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = PartEncoder(path, kept)
        keep("tokens", _encoders[path, kept].forget)
    return _encoders[path, kept]
