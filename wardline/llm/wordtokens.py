"""Ids of whole texts by a tokenizer file whose words are independent of each other.

The tokenizer drops white space and merges within words only, so a text's ids are those of its
white-space chunks one after another. A batch of texts is split and dictionary-encoded by Arrow, and
only its different chunks are looked up: first in a memo of the worker, then by the tokenizers library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardline.llm.common import worker_memo

MEMO_WORDS = 500_000
# The tokenizer's own word pattern (fixed value).
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Chunk to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(_WORD).findall
        self.memo: dict[str, bytes] = {"": b""}
        # Printable stand-ins of the 256 bytes, in the order byte-level vocabularies use them.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.stand_in = dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case, composed word of the pattern."""
        ids = self.memo.get(word)
        if ids is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            found = self.model.tokenize(word.encode().decode("latin-1").translate(self.stand_in))
            ids = self.memo[word] = np.array([t.id for t in found], "<u4").tobytes()
        return ids

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) >= "ɐ" or "<|" in chunk or not unicodedata.is_normalized("NFC", chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        # Below U+0250 lower-casing goes letter by letter and needs no context.
        lower = chunk.lower()
        if lower.isalpha():
            return self._word(lower)
        if lower[-1] in ".,!?;:" and lower[:-1].isalpha():
            return self._word(lower[:-1]) + self._word(lower[-1])
        if min(chunk) < " " or "\x85" in chunk or "\xa0" in chunk:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._word, self.split(lower)))


def batch_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and each text's number of ids. Null reads as empty."""
    words = worker_memo(f"word_ids_{path}", lambda: WordIds(path))
    column = pc.fill_null(column, "")
    special = pc.match_substring(column, "<|")
    if pc.any(special).as_py():  # a control string could span white space
        each = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
                if s else batch_ids(pa.array([t]), path)[0]
                for t, s in zip(column.to_pylist(), special.to_pylist())]
        return np.concatenate(each).astype("<u4"), np.array([len(x) for x in each], np.int64)
    split = pc.ascii_split_whitespace(column)
    coded = split.flatten().dictionary_encode()
    known = [words.chunk(w) for w in coded.dictionary.to_pylist()]
    flat = np.frombuffer(b"".join(known), "<u4")
    size = np.fromiter((len(k) >> 2 for k in known), np.int64, len(known))
    begin = np.cumsum(size) - size
    at = coded.indices.to_numpy(zero_copy_only=False)
    sizes = size[at]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    ids = flat[np.repeat(begin[at] - ends[:-1], sizes) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, "<u4")
    bounds = split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    return ids, np.diff(ends[bounds])
