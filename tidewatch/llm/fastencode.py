"""Whole texts to token ids with the ``tokenizers`` library, piece by piece.

Texts are cut where the tokenizer never joins what stands on both sides: before a
blank that a non-blank follows, and between a letter and closing punctuation.
Arrow finds the distinct pieces of a batch; only pieces not seen lately go to the
library, many in one call, kept apart by one of its own added tokens. The ids of a
text are those of its pieces in order, equal to those of the whole text.

Whether a file can be cut this way is read from the file: its normaliser and its
splitting must be one of the two forms in ``FORMS``. With any other form, or without
an added token to keep pieces apart, every text goes to the library whole. So does a
text that holds the mark used for the cuts or an added token of the file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
_MARK = "\x1f"
#: Unicode white space other than the blank, as RE2's \s is ASCII only.
_WHITE = "\t-\r \u0085   -     　"
_CALL_CHARS = 1 << 18


class Pieces:
    """Cutting, keeping and putting together; subclasses encode what is new.

    ``spaces_matter``: blanks and case are part of the tokens (byte-level vocabularies). Otherwise the tokenizer
    drops white space and lower-cases by itself, and both may be unified before.
    """

    #: Pieces kept in a worker. When there are more they become the older ones, and of those before only the ones met since stay.
    most_kept = 400_000

    def __init__(self, spaces_matter: bool):
        self.spaces_matter = spaces_matter
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The ids of a text that can't be cut."""
        raise NotImplementedError

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into ``kept``."""
        raise NotImplementedError

    def _odd(self, texts: pa.Array) -> pa.Array:
        """Which texts can't be cut."""
        return pc.match_substring(texts, _MARK)

    def _marked(self, texts: pa.Array) -> pa.Array:
        if self.spaces_matter:
            texts = pc.replace_substring_regex(texts, f"( [^{_WHITE}])", _MARK + r"\1")
        else:
            texts = pc.ascii_lower(texts)
            for c in (" ", "\n"):
                texts = pc.replace_substring(texts, c, _MARK)
        return pc.replace_substring_regex(texts, r"([a-zA-Z])([.,;:!?|*#$%&])", r"\1" + _MARK + r"\2")

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, null as empty; a slice of the batch at a time."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
            yield from self._encode_slice(texts.slice(at, end - at))
            at = end

    def _encode_slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = np.flatnonzero(self._odd(texts).to_numpy(zero_copy_only=False))
        apart = {int(k): np.frombuffer(self.whole(texts[int(k)].as_py()), np.uint32) for k in odd}
        if apart:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)
        lists = pc.split_pattern(self._marked(texts), _MARK)
        words = lists.flatten().dictionary_encode()
        lookup, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        if len(self.kept) > self.most_kept:
            self.kept, self.older = {}, self.kept
        new = []
        for p in lookup:
            if p not in self.kept:
                if (ids := self.older.get(p)) is None:
                    new.append(p)
                else:
                    self.kept[p] = ids
        self._learn(new)
        chunks = [self.kept[p] for p in lookup]
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4
        pool, starts = np.frombuffer(b"".join(chunks), np.uint32), np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.cumsum(n)
        pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - n), n)
        ids = pool[pick]
        bounds = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for k in range(len(texts)):
            yield apart[k] if k in apart else ids[bounds[k] : bounds[k + 1]]


#: The forms of tokenizer files that may be cut, as (normaliser, splitting), by whether blanks matter.
FORMS = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


class PieceEncoder(Pieces):
    """New pieces go to a tokenizer file's own encoder."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        given = json.loads(Path(path).read_text("utf-8"))
        form = next((k for k, v in FORMS.items() if v == (given.get("normalizer"), given.get("pre_tokenizer"))), None)
        super().__init__(bool(form))
        self.lib = Tokenizer.from_file(path)
        self.added = given.get("added_tokens", [])
        plain = [t for t in self.added if not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
        self.between = plain[0] if plain else None
        self.cuttable = form is not None and self.between is not None and not any((given.get("truncation"), given.get("padding"), given["model"].get("dropout")))

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _odd(self, texts: pa.Array) -> pa.Array:
        odd = super()._odd(texts)
        if not self.cuttable:
            return pc.or_(odd, True)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t["content"], ignore_case=t["normalized"]))
        return odd

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't kept."""
        at, between = 0, self.between["content"] if self.between else ""
        while at < len(pieces):
            end, chars = at, 0
            while end < len(pieces) and chars < _CALL_CHARS:
                chars += len(pieces[end]) + len(between)
                end += 1
            ids = np.asarray(self.lib.encode_batch_fast([between.join(pieces[at:end])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.between["id"]) if self.between else np.array([], np.int64)
            if len(ends) != end - at - 1:
                raise ValueError("a piece of text holds an added token")
            data, bounds = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            for p, a, b in zip(pieces[at:end], bounds, bounds[1:], strict=False):
                self.kept[p] = data[4 * a + 4 : 4 * b]
            at = end


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder in each worker process, so its kept pieces serve all tasks there."""
    return PieceEncoder(path)
