"""Hierarchical packing: documents are routed to tiers of context sizes, each tier is packed, gaps of long windows are
filled from shorter tiers, and sequences are dealt into step groups of even token counts."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from glyphmill.llm.common import TEXT_ROWS, arrow_schema, batch_of, rows_of, small_batches, written

#: Context sizes, all powers of two.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Documents that a task holds before it packs them, by tokens.
WINDOW_TOKENS = 4_000_000
#: Sequences of a step group hold about this many tokens.
STEP_TOKENS = 64 * 2048
_ID_BYTES = 4
#: Texts of about so many characters are looked up together; so many new words are tokenized in one call.
GROUP_CHARS, JOINED = 1_000_000, 256

# Texts that, lower-cased, have these characters only are cut into words here and looked up in a cache; others go to the tokenizer whole.
# Below U+0250 no character combines with another, so that each word is tokenized alone as in its text.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a0-\\u024f\\u2010-\\u2027\\u2030-\\u203a]*")
_LETTER = "A-Za-z\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_DIGIT = "0-9\\u00b2\\u00b3\\u00b9\\u00bc-\\u00be"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")


class WordIds(dict):
    """Ids of lower-cased words, and of the pieces that a word is cut into, as little-endian unsigned 32-bit values; a worker's cache stays bounded."""

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer, self.by_piece, self.most = Tokenizer.from_file(path), Tokenizer.from_file(path), most
        self.by_piece.normalizer = normalizers.Sequence([])
        self.by_piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Pieces not known yet are tokenized JOINED at a time, with spaces between them; words of several are put together."""
        cut = [(w, _PIECES.findall(w)) for w in words]
        new = [*{p for _, pieces in cut for p in pieces if p not in self}]
        for i in range(0, len(new), JOINED):
            own = new[i : i + JOINED]
            told = self.by_piece.encode(" ".join(own), add_special_tokens=False)
            ids = np.array(told.ids, dtype="<u4").tobytes()
            at = (np.searchsorted(told.word_ids, np.arange(len(own) + 1)) * _ID_BYTES).tolist()
            self.update((p, ids[a:b]) for p, a, b in zip(own, at, at[1:], strict=False))
        self.update((w, b"".join([self[p] for p in pieces])) for w, pieces in cut if len(pieces) != 1)

    def ids(self, text: str) -> bytes:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Each distinct word is looked up once, and those that the cache lacks are learned together."""
        low = [t.lower() for t in texts]
        plain = ["<|" not in t and _PLAIN.fullmatch(x) is not None for t, x in zip(texts, low, strict=True)]
        lists = pc.utf8_split_whitespace(pa.array([x if p else "" for x, p in zip(low, plain, strict=True)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.get, words)]
        if lacks := [i for i, ids in enumerate(found) if ids is None]:
            if len(self) + len(lacks) > self.most:
                self.clear()
            self.learn([words[i] for i in lacks])
            for i in lacks:
                found[i] = self[words[i]]
        taken = pa.array(found, pa.large_binary()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, taken), pa.scalar(b"", pa.large_binary()))
        return [ids if p else self.whole(t) for t, p, ids in zip(texts, plain, joined.to_pylist(), strict=True)]


_loaded: dict[str, WordIds] = {}


def words(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def grouped(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (doc, text, ...) in runs that end at GROUP_CHARS characters of text or TEXT_ROWS rows."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= GROUP_CHARS or len(group) >= TEXT_ROWS:
            yield group
            group, size = [], 0
    if group:
        yield group


class Packer:
    """Packs documents, given as byte strings of ids, into full sequences. One task's state is one window of documents."""

    def __init__(self, task: int):
        self.task, self.n, self.out = task, 0, []
        self.pools: dict[int, list] = {}
        self.held = 0
        self.steps: list[tuple[int, int]] = []

    def add(self, doc, ids: bytes) -> None:
        """Full windows are cut off at once; the rest is routed to the smallest tier that holds it."""
        total, at, longest = len(ids) // _ID_BYTES, 0, TIERS[0]
        while total - at >= longest:
            self.sequence([(doc, ids, at, longest, total)], longest)
            at += longest
        if at < total:
            self.route((doc, ids, at, total - at, total))

    def route(self, piece: tuple) -> None:
        tier = min(t for t in TIERS if t >= piece[3])
        insort(self.pools.setdefault(tier, []), (piece[3], self.held, piece))
        self.held += 1

    def largest(self, most: int) -> tuple | None:
        """Takes the largest pooled piece of at most so many tokens."""
        for tier in TIERS:
            pool = self.pools.get(tier, [])
            i = bisect_right(pool, (most, float("inf")))
            if i:
                return pool.pop(i - 1)[2]
        return None

    def any_longer(self, most: int) -> tuple | None:
        """Takes the shortest pooled piece of more than so many tokens."""
        for tier in reversed(TIERS):
            pool = self.pools.get(tier, [])
            i = bisect_right(pool, (most, float("inf")))
            if i < len(pool):
                return pool.pop(i)[2]
        return None

    def pack(self) -> None:
        """Each tier in turn, from the longest: a window starts with the tier's longest piece, its gap takes the largest
        whole pieces that fit from this and shorter tiers, and what no whole piece fills is cut from a longer one."""
        for tier in TIERS:
            pool = self.pools.get(tier, [])
            while pool:
                room, pieces = tier, []
                while room:
                    piece = pool.pop()[2] if not pieces else self.largest(room)
                    if piece is None:
                        longer = self.any_longer(room)
                        if longer is None:
                            break
                        doc, ids, at, n, total = longer
                        piece = (doc, ids, at, room, total)
                        self.route((doc, ids, at + room, n - room, total))
                    pieces.append(piece)
                    room -= piece[3]
                if room:  # all shorter pieces are used up: full smaller windows are cut off, a tail under the smallest tier stays
                    self.pools = {}
                    self.tail(pieces)
                    return
                self.sequence(pieces, tier)

    def tail(self, pieces: list[tuple]) -> None:
        for tier in TIERS[1:]:
            if sum(p[3] for p in pieces) >= tier:
                room, own, rest = tier, [], []
                for doc, ids, at, n, total in pieces:
                    if k := min(n, room):
                        own.append((doc, ids, at, k, total))
                    if n > k:
                        rest.append((doc, ids, at + k, n - k, total))
                    room -= k
                self.sequence(own, tier)
                pieces = rest
        for p in pieces:
            self.route(p)

    def sequence(self, pieces: list[tuple], tier: int | None) -> None:
        number, offset = (self.task << 32) + self.n, 0
        if tier:
            self.n += 1
            self.steps.append((tier, len(self.out)))
        for doc, ids, at, n, total in pieces:
            crc = zlib.crc32(ids[at * _ID_BYTES : (at + n) * _ID_BYTES])
            self.out.append([doc, at, n, crc, total, number if tier else None, offset if tier else None, tier, None])
            offset += n

    def flush(self, last: bool) -> list[list]:
        """Rows so far. Sequences go to the step group with the fewest tokens, the longest first."""
        self.pack()
        if last:
            for pool in self.pools.values():
                for _, _, p in pool:
                    self.sequence([p], None)
            self.pools = {}
        tokens = sum(t for t, _ in self.steps)
        groups = [(0, (self.task << 32) + self.n_steps + g) for g in range(max(1, round(tokens / STEP_TOKENS)))]
        self.n_steps += len(groups)
        starts = [i for _, i in self.steps] + [len(self.out)]
        group_of = {}
        for tier, i in sorted(self.steps, key=lambda s: (-s[0], s[1])):
            load, g = heapq.heappop(groups)
            group_of[i] = g
            heapq.heappush(groups, (load + tier, g))
        for a, b in zip(starts, starts[1:], strict=False):
            for row in self.out[a:b]:
                if row[7]:
                    row[8] = group_of[a]
        out, self.out, self.steps = self.out, [], []
        return out

    n_steps = 0


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """For each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier int (context size), step_group long.

    A document is its ids and then id 1; a null or empty text is id 1 alone. Every id is in one piece. Sequences are
    full windows of a tier; tails of tasks, under the smallest tier each, are put together in padded windows
    of the longest tier at the end. Rows with a null id and repeated rows are packed like others, and among tails null ids come
    last; a very long text spans several sequences; other columns are ignored, whatever their names; an empty table gives no rows. Tasks pack what they read without a shuffle, so that a lost task gives the
    same pieces again.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("task"))

    schema = arrow_schema(_SCHEMA)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, tokens, end = words(path), None, 0, END_ID.to_bytes(_ID_BYTES, "little")
        for group in grouped(row for batch in batches for row in rows_of(batch)):
            packer = packer or Packer(group[0][2])
            for (doc, _, _), ids in zip(group, own.of_all([r[1] for r in group]), strict=True):
                packer.add(doc, ids + end)
                tokens += len(ids) // _ID_BYTES + 1
                if tokens >= WINDOW_TOKENS:
                    yield batch_of(packer.flush(False), schema)
                    tokens = 0
        own.clear()  # the worker lives on for other tasks
        if packer:
            yield batch_of(packer.flush(True), schema)

    pieces = written(rows.mapInArrow(packed, _SCHEMA), "pack-pieces")
    tails = pieces.where("sequence_id is null")

    def joined(tail: pa.Table) -> pa.Table:
        out, room, n = [], 0, -1
        found = sorted(rows_of(tail), key=lambda r: (r[1] is None, r[1] or 0, r[2:]))  # r[0] is the bin
        for number, doc, start, length, crc, total in found:
            base = (1 << 62) + (number << 32)
            if length > room:
                room, n = TIERS[0], n + 1
            out.append((doc, start, length, crc, total, base + n, TIERS[0] - room, TIERS[0], base))
            room -= length
        return pa.Table.from_batches([batch_of(out, schema)])

    # tails hold less than the smallest tier for each task, so that they follow the number of tasks; each bin has a few thousands
    bins = F.expr("cast(pmod(xxhash64(doc_id, start, ids_crc32), greatest(1, cast(ceil(n / 20000.0) as int))) as long)")
    many = tails.crossJoin(F.broadcast(tails.agg(F.count(F.lit(1)).alias("n"))))
    filled = many.select(bins.alias("bin"), "doc_id", "start", "length", "ids_crc32", "doc_tokens").groupBy("bin").applyInArrow(joined, _SCHEMA)
    return pieces.where("sequence_id is not null").unionByName(filled)
