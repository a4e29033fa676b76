"""Byte-level BPE ids of whole texts by forced boundaries.

Two neighbouring bytes that stand next to each other in no vocabulary token can never
be merged, so the text may be cut between them and the fragments encoded one by one.
The rule that first splits text into words must see the same words on both sides of a
cut; that holds for a cut before ASCII white space (whatever precedes it, the split of
a run of white space looks only ahead) and between two printable ASCII characters
neither of which is an apostrophe (the only character whose meaning depends on where a
word starts). Other certain pairs are not used as cuts. The strings of added tokens
count as vocabulary, so none of them is ever cut.

Fragments repeat (most are words with the space before them). Of a slice of rows each
different one is looked at once; a worker keeps the ids of up to ``CACHE`` fragments and
gives unknown ones to the library, joined.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from panelmark.llm.common import byte_view

#: Fragments whose ids a worker keeps (about 150 MB); further ones are encoded again.
CACHE = 600_000
_ONE_WORD = re.compile(r" ?\S+")
#: Latin letters with at most a space before them are one word for the library's model.
_LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which the file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids and texts of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            added = [x["content"] for x in json.load(file)["added_tokens"]]
        letters = _byte_letters()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.added = [x.encode() for x in added]
        self.letters = {b: c for c, b in letters.items()}
        self.cuts = self._cut_table()
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def _cut_table(self) -> np.ndarray:
        """For each two bytes: whether a text is certain to be cut between them."""
        inside = np.zeros(65536, bool)
        for piece in [*self.pieces, *self.added]:
            b = np.frombuffer(piece, np.uint8).astype(np.int64)
            inside[b[:-1] << 8 | b[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        gap = np.isin(right, [0x20, *range(0x09, 0x0E)])
        plain = [(x > 0x20) & (x < 0x7F) & (x != 0x27) for x in (left, right)]
        return ~inside & (gap | plain[0] & plain[1])

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different fragments of a slice of rows, the number of each fragment in turn among these,
        and the index of each row's first (and the end)."""
        if not len(data):
            return [], np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        cut[1:] = self.cuts[pair]
        filled = offsets[:-1][np.diff(offsets) > 0]
        cut[filled] = True
        at = np.flatnonzero(cut)
        buffers = [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        blob, ends = byte_view(found.dictionary)
        blob, ends = blob.tobytes(), ends.tolist()
        return [blob[a:b] for a, b in zip(ends, ends[1:])], found.indices.to_numpy(), np.searchsorted(at, offsets)

    def _learn(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        found, joined = {}, []
        tokenize = self.library.model.tokenize
        for fragment in unknown:
            text = fragment.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):
                letters = fragment.decode("latin-1").translate(self.letters)
                found[fragment] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            elif _ONE_WORD.fullmatch(text) and not any(x in fragment for x in self.added):
                joined.append((fragment, text))
            else:
                found[fragment] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        for k in range(0, len(joined), 20_000):  # a line break between words is a word, and an id, of its own
            part = joined[k : k + 20_000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(t for _, t in part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.newline[0])
            if len(ends) != len(part) - 1:
                raise RuntimeError("joined fragments were not encoded apart")
            starts = np.concatenate([[0], ends + 1])
            raw = ids.tobytes()
            for (fragment, _), a, b in zip(part, (starts * 4).tolist(), [*(ends * 4).tolist(), len(raw)], strict=True):
                found[fragment] = raw[a:b]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """For each row of the slice its ids as little-endian unsigned 32-bit integers."""
        parts, number, bounds = self.fragments(data, offsets)
        if not parts:
            return [b""] * (len(offsets) - 1)
        known = self.known
        ids = list(map(known.get, parts))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            found = self._learn([parts[i] for i in missing])
            for i in missing:
                ids[i] = found[parts[i]]
            room = CACHE - len(known)
            known.update(found if len(found) <= room else list(found.items())[: max(0, room)])
        # the ids of different fragments stand behind each other once, and are taken from there fragment by fragment
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[number]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1])
        places += np.repeat(starts[number] - (ends - counts), counts)
        raw = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        cuts = (np.append(0, ends)[bounds] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes the ids stand for."""
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker process."""
    return Encoder(path)
