"""Byte-level BPE in DuckDB, one in-memory database per task: encode by a recursive query, decode by an
ordered aggregate.

Texts are split by the pattern; a task's new pieces become rows (piece, position, token). Each step of the
recursive query joins neighbouring tokens with the merge table and contracts every piece's minimum-rank pair,
leftmost first, until no piece has a pair left. All occurrences of that pair are contracted in one
step where this provably equals one at a time, i.e. where no token that contains the merged one has a
smaller rank. Pieces are cut beforehand at byte pairs that no token contains, which no merge can cross.

A piece of LONG_PIECE bytes or more is contracted in overlapping windows. Ids are the encoding of a piece exactly if each two
neighbours are the encoding of their joined bytes, so two windows that share a token at the same place are
joined at it without a difference; windows that share none are united and contracted again, at worst up to the
whole piece. Windows go to the database in groups of bounded work.

Null and empty texts have no ids. Ranks must cover all 256 bytes; every text then has ids, and decoding gives
its UTF-8 bytes back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, texts, worker_memo

MEMO_PIECES = 500_000
DECODE_IDS = 2_000_000
LONG_PIECE, STEP = 512, 30  # windows of two steps
GROUP_SQUARES = 8_000_000  # sum of the squared lengths of pieces contracted at once
# White space to the pattern is Unicode's property White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
# A chunk of the text: the pattern never matches across two of them.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_CONTRACT = """
WITH RECURSIVE step(round, piece, pos, token) USING KEY (piece, pos) AS (
  SELECT 0, piece, pos, token FROM fresh
  UNION ALL
  SELECT round + 1, piece, pos, CASE WHEN taken THEN lowest ELSE token END
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS gone
    FROM (
      SELECT *, hit AND CASE WHEN lowest IN (SELECT id FROM one_by_one)
                             THEN pos = min(pos) FILTER (hit) OVER (PARTITION BY piece)
                             ELSE (place - min(place) OVER (PARTITION BY piece, hit, place - run)) % 2 = 0 END AS taken
      FROM (
        SELECT *, row_number() OVER (PARTITION BY piece, hit ORDER BY pos) AS run
        FROM (
          SELECT round, piece, pos, token, place, lowest, coalesce(merged = lowest, false) AS hit
          FROM (
            SELECT p.*, m.id AS merged, min(m.id) OVER (PARTITION BY piece) AS lowest
            FROM (SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS after,
                         row_number() OVER (PARTITION BY piece ORDER BY pos) AS place FROM step) p
            LEFT JOIN merges m ON m.a = p.token AND m.b = p.after)
          WHERE lowest IS NOT NULL))))
  WHERE NOT gone
)
SELECT piece, list(token ORDER BY pos) AS ids
FROM step JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) USING (piece, round)
GROUP BY piece
"""
# The same for pieces under 64 bytes, whose tokens fit one number each (64 x piece + position, and where the
# token stops) and are joined without sorting; every step contracts one pair per piece.
_CONTRACT_SHORT = """
WITH RECURSIVE step(round, key, stop, token) AS (
  SELECT 0, key, key + 1, token FROM fresh
  UNION ALL
  SELECT s.round + 1, s.key, CASE WHEN s.key = best.at THEN best.stop ELSE s.stop END,
         CASE WHEN s.key = best.at THEN best.id ELSE s.token END
  FROM step s JOIN (
    SELECT piece, piece * 64 + packed // 16384 % 64 AS at, piece * 64 + packed // 128 % 128 AS gone,
           piece * 64 + packed % 128 AS stop, packed // 1048576 AS id
    FROM (SELECT p.key // 64 AS piece, min(m.id::BIGINT * 1048576 + p.key % 64 * 16384 + q.key % 64 * 128
                                           + q.stop - p.key + p.key % 64) AS packed
          FROM step p JOIN step q ON q.key = p.stop JOIN pairs m ON m.ab = p.token * 65536 + q.token
          GROUP BY p.key // 64)) best ON best.piece = s.key // 64
  WHERE s.key <> best.gone
)
SELECT piece, list(token ORDER BY key) AS ids
FROM (SELECT key // 64 AS piece, round, key, token::INTEGER AS token FROM step)
JOIN (SELECT key // 64 AS piece, max(round) AS round FROM step GROUP BY 1) USING (piece, round)
GROUP BY piece
"""
_DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The merge table of one vocabulary in a DuckDB database of this worker, with a memo of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.memo: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        merges = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        a, b, merged = (np.array(x, np.int32) for x in zip(*merges)) if merges else [np.zeros(0, np.int32)] * 3
        # Merged tokens that a token of smaller rank contains are contracted one at a time.
        early = np.unique(np.concatenate((a[merged < a], b[merged < b])))
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            raw = np.frombuffer(t, np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '600MB'; SET temp_directory = ''")
        self._create("merges", a=a, b=b, id=merged)
        self._create("pairs", ab=a.astype(np.int64) * 65536 + b, id=merged)
        self._create("one_by_one", id=early.astype(np.int32))
        self.db.register("given", pa.table({"id": pa.array(list(ranks.values()), pa.int32()),
                                            "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given").unregister("given")

    def _create(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given").unregister("given")

    def _contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        cut = np.concatenate((self.joined[raw[:-1], raw[1:]], [False]))
        starts = np.concatenate(([True], ~cut[:-1]))
        starts[np.cumsum(sizes)[:-1]] = True
        part = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        bounds = np.append(first, len(raw))
        keys = [raw[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]
        different = dict.fromkeys(keys)
        found = self._encoded([k for k in different if len(k) < LONG_PIECE])
        found |= self._stitched([k for k in different if len(k) >= LONG_PIECE])
        word_first = np.concatenate((part[np.cumsum(sizes) - sizes], [len(keys)]))
        return [np.concatenate([found[k] for k in keys[i:j]]) for i, j in zip(word_first, word_first[1:])]

    def _encoded(self, keys: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each key, contracted in groups of bounded work."""
        found = {}
        short = [k for k in keys if len(k) < 64]
        long = [k for k in keys if len(k) >= 64]
        for keys_of, query, fresh in ((short, _CONTRACT_SHORT, self._short_rows), (long, _CONTRACT, self._long_rows)):
            work = np.cumsum([len(k) ** 2 for k in keys_of])
            begin = 0
            while begin < len(keys_of):
                before = work[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(work, before + GROUP_SQUARES, "right")))
                group = keys_of[begin:end]
                begin = end
                self.db.register("fresh", fresh(group))
                got = self.db.execute(query).to_arrow_table().sort_by("piece")["ids"]
                self.db.unregister("fresh")
                flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.chunks])
                at = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(got).to_numpy())))
                found |= {k: flat[x:y] for k, x, y in zip(group, at, at[1:])}
        return found

    def _stitched(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each long word, from windows joined at common tokens."""
        spans = {w: [(s, min(s + 2 * STEP, len(w))) for s in range(0, len(w) - STEP, STEP)] for w in words}
        known: dict[bytes, np.ndarray] = {}
        result = {}
        while spans:
            known |= self._encoded(list({w[s:e] for w, of in spans.items() for s, e in of} - known.keys()))
            wider = {}
            for w, of in spans.items():
                result[w], again = self._joined([(s, known[w[s:e]]) for s, e in of], of)
                if again:
                    wider[w] = again
            spans = wider
        return result

    def _joined(self, windows: list[tuple[int, np.ndarray]], spans: list[tuple[int, int]]):
        """The ids that follow from windows (start, ids), or the wider spans to try instead."""
        kept, again, failed, grown = [], [spans[0]], False, False
        begin, places = 0, None
        for i, (start, ids) in enumerate(windows):
            ends = np.cumsum(self.size[ids])
            here = (start + ends - self.size[ids] << 32) + ids
            if i:
                _, left, right = np.intersect1d(places, here, True, return_indices=True)
                if len(left):
                    kept.append(windows[i - 1][1][begin:left[0]])
                    begin = right[0]
                failed |= not len(left)
                if len(left) or grown:  # a span grows by one neighbour a round
                    again.append(spans[i])
                    grown = False
                else:
                    again[-1] = (again[-1][0], spans[i][1])
                    grown = True
            places = here
        if failed:
            return None, again
        return np.concatenate((*kept, windows[-1][1][begin:])), None

    def _positions(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(k) for k in keys], np.int64)
        pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return np.repeat(np.arange(len(keys)), length), pos, self.byte_id[np.frombuffer(b"".join(keys), np.uint8)]

    def _short_rows(self, keys: list[bytes]) -> pa.Table:
        piece, pos, token = self._positions(keys)
        return pa.table({"key": piece * 64 + pos, "token": token.astype(np.int64)})

    def _long_rows(self, keys: list[bytes]) -> pa.Table:
        piece, pos, token = self._positions(keys)
        return pa.table({"piece": piece.astype(np.int32), "pos": pos.astype(np.int32), "token": token})

    def encode(self, docs: list[str]) -> list[str]:
        """Each text's decimal ids with a space before every id."""
        split = [_CHUNK.findall(d) for d in docs]
        if len(self.chunks) > MEMO_PIECES:
            self.chunks.clear()
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        fresh = {c: self.split(c) for c in {c for d in split for c in d} - self.chunks.keys()}
        new = list({p for found in fresh.values() for p in found} - self.memo.keys())
        if new:
            for p, ids in zip(new, self._contracted([p.encode() for p in new])):
                self.memo[p] = "".join([f" {i}" for i in ids.tolist()])
        for c, found in fresh.items():
            self.chunks[c] = "".join([self.memo[p] for p in found])
        return ["".join([self.chunks[c] for c in d]) for d in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        result = [b""] * len(ids)
        start = 0
        while start < len(ids):
            end, held = start, 0
            while end < len(ids) and (end == start or held + len(ids[end]) <= DECODE_IDS):
                held += len(ids[end])
                end += 1
            sizes = np.array([len(x) for x in ids[start:end]], np.int64)
            self.db.register("ids", pa.table({
                "doc": np.repeat(np.arange(start, end, dtype=np.int32), sizes),
                "pos": np.arange(held, dtype=np.int32),
                "id": np.concatenate(ids[start:end]).astype(np.int32)}))
            for doc, hexed in self.db.execute(_DECODE).fetchall():
                result[doc] = bytes.fromhex(hexed)
            self.db.unregister("ids")
            start = end
        return result


def _numbers(spaced: str) -> np.ndarray:
    return np.fromstring(spaced, np.int32, sep=" ") if spaced else np.zeros(0, np.int32)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row."""

    def use(codec: Codec, column: pa.Array) -> dict:
        return {"ids": pa.array([_numbers(s) for s in codec.encode(texts(column))], pa.list_(pa.int32()))}

    return _mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ranks_path, pattern, use,
                   "ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of every row of (doc_id, ids)."""

    def use(codec: Codec, column: pa.Array) -> dict:
        flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        at = at - at[0]
        return {"bytes": pa.array(codec.decode([flat[i:j] for i, j in zip(at, at[1:])]), pa.binary())}

    return _mapped(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>"))), ranks_path, pattern, use,
                   "bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, in one pass."""

    def use(codec: Codec, column: pa.Array) -> dict:
        spaced = codec.encode(texts(column))
        ids = [_numbers(s) for s in spaced]
        decoded = codec.decode(ids)
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(s[1:].encode()).hexdigest() for s in spaced], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())}

    return _mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ranks_path, pattern, use,
                   "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(rows: DataFrame, ranks_path: str, pattern: str, use, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_memo(f"byte_bpe_{ranks_path}", lambda: Codec(read_ranks(ranks_path), pattern))
        for b in pieces(batches):
            out = use(codec, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *out.values()], ["doc_id", *out])

    return rows.mapInArrow(run, f"doc_id long, {schema}")
