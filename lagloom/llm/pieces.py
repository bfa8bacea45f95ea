"""Exact token ids by the tokenizers library, with a bounded memory of words.

A byte-pair tokenizer with a regular-expression pre-tokenizer never merges across a boundary of pre-tokens, and no
pre-token of the supported kinds holds a space after another character. A text may therefore be cut before every
space that follows a character other than white space, each piece encoded alone, and the ids joined. Pieces recur, so
their ids are remembered per worker (at most ``limit`` pieces of at most 64 characters, so a bounded number of bytes; others
are encoded anew, with the same ids).
Tokenizers of any other kind get the whole text in one call.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a piece that is worth remembering.
LONGEST = 64
_CUT = re.compile(r"(?<=\S) ")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; names with a slash are paths already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """``encode`` gives the ids of each text as little-endian unsigned 32-bit integers, ``encode_array`` all in one array."""

    def __init__(self, name: str, limit: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.lib = Tokenizer.from_file(path)
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        text = json.dumps(spec["pre_tokenizer"])
        plain = not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]) and not (spec["truncation"] or spec["padding"] or spec["post_processor"])
        model = spec["model"]
        bpe = plain and model["type"] == "BPE" and not model.get("dropout")
        names = [(model["vocab"][t], t) for t in model["vocab"]]
        size = max(i for i, _ in names) + 1
        self.kind = ""
        if bpe and spec["pre_tokenizer"]["type"] == "ByteLevel" and '"use_regex": true' in text and not spec["pre_tokenizer"]["add_prefix_space"] and spec["normalizer"] is None:
            self.kind = "space"  # a token that begins a spaced word says so
            self.edge = np.zeros(size, bool)
            self.edge[[i for i, t in names if t.startswith("Ġ")]] = True
        elif bpe and model["end_of_word_suffix"] and '"behavior": "Removed"' in text and '"invert": true' in text:
            self.kind = "suffix"  # a token that ends a word says so
            self.edge = np.zeros(size, bool)
            self.edge[[i for i, t in names if t.endswith(model["end_of_word_suffix"])]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words: dict[str, bytes] = {}
        #: A character between pieces; as a word of its own it has ids that no piece without it holds.
        self.between = self._plain([" \x01"])[0]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of ``" " + piece`` for pieces without special strings, by one call for many pieces."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 64):
            some = pieces[at : at + 64]
            if self.kind == "space":
                ids = np.asarray(self.lib.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(self.edge[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                ids = np.asarray(self.lib.encode_batch_fast([" \x01 ".join(["", *some, ""])], add_special_tokens=False)[0].ids, "<u4")
                marks = np.flatnonzero(ids == np.frombuffer(self.between, "<u4")[0])
                starts, ends = marks[:-1] + 1, marks[1:]
            if len(starts) != len(some):
                out += self._plain([" " + p for p in some])
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of ``" " + piece`` for each of the (distinct) pieces; words are remembered while there is room."""
        got = list(map(self.words.get, pieces))
        gaps = [i for i, v in enumerate(got) if v is None]
        many, alone = [], []
        for i in gaps:
            p = pieces[i]
            (alone if "\x01" in p or p[:1].isspace() or p[-1:].isspace() or any([x in p for x in self.special]) else many).append(i)
        for i, ids in zip(many, self._joined([pieces[i] for i in many]), strict=True):
            got[i] = ids
        for i, ids in zip(alone, self._plain([" " + pieces[i] for i in alone]), strict=True):
            got[i] = ids
        room = self.limit - len(self.words)
        if room > 0:
            self.words.update([(pieces[i], got[i]) for i in many if len(pieces[i]) <= LONGEST][:room])
        return got

    def _careful(self, text: str) -> bytes:
        """For texts in which white space stands before a space: cut only where that is right."""
        head, *rest = _CUT.split(text)
        found = dict(zip(own := list(dict.fromkeys(rest)), self._spaced(own), strict=True))
        return self._plain([head])[0] + b"".join([found[p] for p in rest])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls are empty) and the n + 1 offsets of the texts among them."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if not self.kind:
            return _stacked(self._plain(texts.to_pylist()))
        # Cut, and number the distinct pieces, in Arrow; Python sees each distinct piece once.
        cut = pc.split_pattern(texts, " ")
        first = np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()
        numbered = cut.flatten().dictionary_encode()
        which, pieces = np.array(numbered.indices), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        unsure = np.asarray([not p or p[-1].isspace() for p in pieces], bool)
        odd = np.logical_or.reduceat(unsure[which], first[:-1]) & (np.diff(first) > 1)
        heads = pc.take(numbered, pa.array(first[:-1])).cast(texts.type).dictionary_encode()
        ids = self._spaced(pieces) + self._plain(heads.dictionary.to_pylist())
        which[first[:-1]] = len(pieces) + np.asarray(heads.indices)
        sizes = np.asarray([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        out = flat[np.repeat(begin[which] - ends + each, each) + np.arange(ends[-1])]
        offsets = np.append(0, ends)[first]
        if odd.any():
            parts = [out[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in np.flatnonzero(odd):
                parts[i] = self._careful(texts[int(i)].as_py())
            return _stacked(parts)
        return out, offsets

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_array(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _stacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.append(0, np.cumsum([len(p) // 4 for p in parts])).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(name: str, limit: int = 400_000) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(name, limit)
