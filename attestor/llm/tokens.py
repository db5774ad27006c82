"""Public tokenizers on executors: exact ids of the tokenizers library, with a bounded cache of short pieces.

A byte-pair tokenizer encodes each pre-token by itself, so the ids of a text are those of its pre-tokens in
order, and a text can be cut wherever pre-tokens surely part. Texts whose characters are all below U+0280 and
ordinary are cut at single spaces and newlines, and each distinct piece of a group of texts is looked up once.
Of pieces that aren't cached, words with final punctuation go to the library's model as one or two pre-tokens;
others are joined, with a separator whose ids nothing else has, and encoded in one call. Any other text, and any
that holds the text of an added token, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attestor.llm.shared import on_release

#: UTF-8 bytes of the characters below U+0280 for which patterns here and in the library surely agree.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
#: White space beside white space, where a byte-level pre-tokenizer doesn't simply part.
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r")
_PIECE_LENGTH = 64
#: Size of the table of hashes of pieces met.
_MET = 1 << 22
_FINAL = ".,!?;:"
#: Cached pieces of a worker, unless it is told otherwise; texts encoded together have eight bytes for each.
CACHED = 500_000
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable Latin-1 stands for itself, the others
    get the characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Encoder:
    """Ids of whole texts; ``path`` is a tokenizers JSON file, ``most`` bounds the cached pieces.

    A piece is cached when it is met a second time (by a table of hashes), as most pieces are met only once; the first
    ``most`` such pieces stay, which the frequent ones are among. Two kinds of tokenizer are cut: byte-level pre-tokenization of the raw text (``spaced``), and lower-cased
    splitting that drops white space.
    """

    def __init__(self, path: str, most: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.cache: dict[bytes, bytes] = {}
        self.met = bytearray(_MET)
        self.added = [t["content"].encode() for t in config.get("added_tokens") or []]
        self.tails: dict[str, bytes] = {}
        self.most, self.spaced, self.cut = most, False, False
        pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
        if config["model"].get("type") == "BPE" and config.get("post_processor") is None:
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
                self.spaced = self.cut = True
            elif pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                split, level = pre["pretokenizers"]
                self.cut = split["behavior"] == "Removed" and split["invert"] and not level["use_regex"]
        #: between pieces: a newline, or a word of a script that no piece has
        self.mark = "\n" if self.spaced else " \u4e2d "
        self.mark_ids = self._whole(self.mark)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces (none holds the mark), from one call."""
        if not pieces:
            return []
        ids = self._whole(self.mark + self.mark.join(pieces))
        n = len(self.mark_ids)
        at = np.flatnonzero(ids == self.mark_ids[0])
        if len(at) != len(pieces):
            raise ValueError("a piece holds the separator")
        raw = ids.tobytes()
        return [raw[4 * (a + n) : 4 * b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]

    def _pretoken(self, text: str) -> bytes:
        """Ids of one pre-token."""
        letters = text if text.isascii() and " " not in text else text.encode().decode("latin-1").translate(_LETTERS)
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()

    def _resolve(self, keys: list[bytes]) -> list[bytes]:
        """Ids of pieces: a key beginning with a newline holds the newline, any other of a spaced text lost its space."""
        out: list = [None] * len(keys)
        rest: list[tuple[int, str, bytes]] = []
        for k, key in enumerate(keys):
            line = key[:1] == b"\n"
            text = (key[1:] if line else key).decode()
            if not self.spaced:
                text = text.lower()
            word = text.rstrip(_FINAL)
            front = self.mark_ids.tobytes() if line else b""
            lead = " " if self.spaced and not line else ""
            if word.isalpha() and len(word) <= _PIECE_LENGTH:
                ids = None if line or word == text else self.cache.get(word.encode())
                out[k] = front + (self._pretoken(lead + word) if ids is None else ids)
                if word != text:
                    tail = text[len(word) :]
                    if tail not in self.tails:
                        if len(self.tails) > 10_000:
                            self.tails.clear()
                        self.tails[tail] = self._pretoken(tail)
                    out[k] += self.tails[tail]
            elif text:
                rest.append((k, lead + text, front))
            else:
                out[k] = front
        for bare in (False, True):  # pieces without a leading space are joined by themselves
            part = [r for r in rest if (r[1][:1] != " ") == bare]
            for (k, _, front), ids in zip(part, self._joined([r[1] for r in part])):
                out[k] = front + ids
        return out

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text, given in UTF-8."""
        out: list = [None] * len(texts)
        cut, prepared = [], []
        for k, data in enumerate(texts):
            if not self.cut or data.translate(None, _PLAIN) or any(t in (data if self.spaced else data.lower()) for t in self.added) or self.spaced and (not data or data[:1].isspace() or data[-1:].isspace() or any(r in data for r in _RUNS)):
                out[k] = self._whole(data.decode("utf-8", "replace"))
            else:  # pieces lose their leading space; a line's first piece takes the newline before it along
                cut.append(k)
                prepared.append(b"\n" + data.replace(b"\n", b" \n") if self.spaced else b" ".join(data.split()))
        if not cut:
            return out
        pieces = pc.split_pattern(pa.array(prepared, pa.large_binary()), b" ")
        coded = pieces.flatten().dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = list(map(self.cache.get, names))
        new = [k for k, v in enumerate(values) if v is None]
        room, met = len(self.cache) < self.most, self.met
        for k, v in zip(new, self._resolve([names[k] for k in new])):
            values[k] = v
            if room:
                h = hash(names[k]) % _MET
                if met[h] and len(names[k]) <= _PIECE_LENGTH:
                    self.cache[names[k]] = v
                met[h] = 1
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat, each = np.frombuffer(b"".join(values), "<u4"), sizes[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.r_[0, ends][pieces.offsets.to_numpy() - pieces.offsets[0].as_py()].tolist()
        skip = len(self.mark_ids) if self.spaced else 0
        for k, a, b in zip(cut, bounds, bounds[1:]):
            out[k] = ids[a + skip : b]
        return out

    def ids(self, data: bytes) -> np.ndarray:
        return self.many([data])[0]

    def groups(self, column: Iterable) -> Iterator[np.ndarray]:
        """Ids of an Arrow column of texts, in order, encoded in groups."""
        group, size = [], 0
        for x in column:
            group.append(x.as_py())
            size += len(group[-1])
            if size >= 8 * self.most:
                yield from self.many(group)
                group, size = [], 0
        yield from self.many(group)


def encoder(path: str, most: int = CACHED) -> Encoder:
    """One encoder for each Python worker and file. It lives on with its cache, for the worker's next task; one that is to
    cache fewer pieces than ``CACHED`` leaves its memory to other work when the task ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    return _ENCODERS[path]


def _leave() -> None:
    for path in [p for p, e in _ENCODERS.items() if e.most < CACHED]:
        del _ENCODERS[path]


on_release(_leave)
