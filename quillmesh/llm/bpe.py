"""Byte-level BPE encoding and decoding.

``encode_word`` and ``decode_ids`` are Spark higher-order functions: they fold the
ranked merges over the byte array of a word, the rank map being literals of the plan
(``slots``, a two-choice hash table by ``xxhash64`` of the piece, and ``tokens``, the
pieces by rank; a rank counts only if its piece is equal, so the map is exact).
``encode_words`` applies them to a table of words.

``encode_documents`` folds each distinct word of the whole table once:

1. Texts are dealt into blocks of about ``block_bytes`` by a hash of the row. A block
   gives its distinct words, packed, to buckets by a hash of the word.
2. A bucket's words are met in a stream; each is handed on the first time, and each block's
   words as numbers of those. ``encode_word`` folds the distinct words (longer than
   ``MAX_FOLD`` bytes: by a heap in Python, the fold by arrays is quadratic in the word).
3. Blocks get the ids of their words back, in the same order, meet their texts
   (co-group) and string ids together; decoding concatenates the ids' binary pieces.

A text is cut at blanks first, and each distinct part by the pattern once: no match
spans a blank that follows a character other than white space, but at its start.

Scale: exchanged are the texts once and, per block, each distinct word and its ids once
(packed: some ten bytes together). Memory is bounded by a block, or a bucket's distinct
words, of which there are about as many per bucket at any size (``bucket_count``). The rank map
is bounded by the vocabulary (50,256 pieces), never by the data. A block holds one
text at least, so a very long text is a block by itself.

Nulls: a null text encodes as the empty text (no ids). Repeated rows give
repeated results; an empty table gives none. Other columns are ignored unless
named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.llm.common import deal_of, free_memory, lean

_NO_RANK = 1 << 30


def load_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece, blank, rank), by rank."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranked[i] for i in range(len(ranked))]


def two_choice_slots(pieces: list[bytes]) -> list[int]:
    """A cuckoo table: piece i is at one of its two slots; -1 where none is."""
    size = 1 << max(4, (len(pieces) * 5 // 2).bit_length())
    places = []
    for piece in pieces:
        h = xxhash.xxh64_intdigest(piece, 42)
        places.append((h & (size - 1), (h >> 32) & (size - 1)))
    slots, rng = [-1] * size, random.Random(7)
    for i in range(len(pieces)):
        item, at = i, places[i][0]
        for _ in range(2000):
            item, slots[at] = slots[at], item
            if item < 0:
                break
            first, second = places[item]
            at = second if at == first else first
            if rng.random() < 0.01:
                at = rng.choice((first, second))
        else:
            raise ValueError("the rank table can't be laid out")
    return slots


class RankLiterals:
    """The rank map as literal columns, made once per rank file."""

    def __init__(self, path: str):
        self.pieces = load_ranks(path)
        self.slots_json = json.dumps(two_choice_slots(self.pieces))
        self.tokens_json = json.dumps([base64.b64encode(p).decode() for p in self.pieces])

    def bind(self, body: Callable[[Column], Column]) -> Column:
        """``body`` of a struct (slots, tokens) that the plan holds only once."""
        table = F.struct(
            F.from_json(F.lit(self.slots_json), "array<int>").alias("slots"),
            F.from_json(F.lit(self.tokens_json), "array<binary>").alias("tokens"),
        )
        return F.element_at(F.transform(F.array(table), body), 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(table: Column, piece: Column) -> Column:
    size_mask = F.size(table["slots"]) - 1

    def at(h: Column, shift: int) -> Column:
        shifted = F.shiftright(h, shift) if shift else h
        return F.get(table["slots"], shifted.bitwiseAND(size_mask.cast("long")).cast("int"))

    def found(h: Column) -> Column:
        first, second = at(h, 0), at(h, 32)
        return (
            F.when(F.get(table["tokens"], first) == piece, first)
            .when(F.get(table["tokens"], second) == piece, second)
            .otherwise(F.lit(_NO_RANK))
        )

    return _let(F.xxhash64(piece), found)


def encode_word(table: Column, word: Column) -> Column:
    """The ids (array<int>) of one word's bytes: the leftmost adjacent pair of
    the lowest rank is merged, until none has a rank. The state holds where each
    piece starts (and the word's end) and the rank of each adjacent pair."""
    none = F.array().cast("array<int>")
    n = F.length(word)

    def span(starts: Column, j: Column, pieces: int) -> Column:
        at = F.get(starts, j)
        return F.substring(word, at, F.get(starts, j + pieces) - at)

    def merge(ranks: Column, starts: Column, i: Column) -> Column:
        def again(r: Column, j: Column) -> Column:
            return F.when((j == i - 1) | (j == i - 2), _rank(table, span(starts, j, 2))).otherwise(r)

        rest = F.filter(ranks, lambda r, j: j != i - 1)
        return F.struct(starts.alias("starts"), F.transform(rest, again).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        starts, ranks = state["starts"], state["ranks"]

        def at(i: Column) -> Column:
            return _let(F.array_remove(starts, F.get(starts, i)), lambda left: merge(ranks, left, i))

        def lowest(rank: Column) -> Column:
            position = F.array_position(ranks, rank).cast("int")
            return F.when(rank < _NO_RANK, _let(position, at)).otherwise(state)

        return F.when(F.size(ranks) > 0, _let(F.array_min(ranks), lowest)).otherwise(state)

    first = F.struct(
        F.sequence(F.lit(1), n + 1).alias("starts"),
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: _rank(table, F.substring(word, i, F.lit(2)))).alias("ranks"),
    )
    folded = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        first,
        step,
        lambda state: F.transform(
            F.sequence(F.lit(0), F.size(state["starts"]) - 2), lambda j: _rank(table, span(state["starts"], j, 1))
        ),
    )
    return F.when(n == 0, none).otherwise(
        _let(_rank(table, word), lambda r: F.when((r < _NO_RANK) | (n == 1), F.array(r)).otherwise(folded))
    )


def decode_ids(table: Column, ids: Column) -> Column:
    """The bytes of an array of ids: the concatenated binary pieces (null: none)."""
    pieces = F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.hex(F.get(table["tokens"], i)))
    return F.unhex(F.array_join(pieces, ""))


def encode_words(words: DataFrame, rank_path: str, word_col: str = "word") -> DataFrame:
    """Distinct ``word_col`` values (binary; null: left out) with their ids
    array<int> and decoded binary, folded by Spark higher-order functions."""
    literals = RankLiterals(rank_path)
    distinct = words.select(F.col(word_col).cast("binary").alias("word")).where("word IS NOT NULL").distinct()
    coded = literals.bind(
        lambda t: _let(encode_word(t, F.col("word")), lambda ids: F.struct(ids.alias("ids"), decode_ids(t, ids).alias("decoded")))
    )
    return distinct.withColumn("coded", coded).select("word", "coded.ids", "coded.decoded")


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: merge the leftmost adjacent pair of the lowest rank
    until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == _NO_RANK:
            break
        i = pairs.index(lowest)
        merged = parts[i] + parts.pop(i + 1)
        parts[i] = merged
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + merged, _NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(merged + parts[i + 1], _NO_RANK)
    return [ranks[p] for p in parts]


def _merge_long_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge_word`` for words of any length, by a heap over a linked list."""
    n = len(word)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int):
        j = nxt[i]
        return ranks.get(word[i : end[j]], _NO_RANK) if j < n else _NO_RANK

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) < _NO_RANK]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
        for k in (prev[i], i):
            if k >= 0 and (r := pair(k)) < _NO_RANK:
                heapq.heappush(heap, (r, k, end[nxt[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Numbers(dict):
    """Parts of texts between blanks -> their numbers; -1 if a part can't be cut by
    itself, being empty or with white space at an end."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def __missing__(self, part: str) -> int:
        whole = part and not (part[0].isspace() or part[-1].isspace())
        self[part] = number = len(self.parts) if whole else -1
        if whole:
            self.parts.append(part)
        return number


class BlockWords:
    """A block of texts as numbers of its distinct parts, and these as words.

    A text is cut at clean blanks, those after another character than white space: a
    part is a blank and what follows it. Most parts have no other blank, and are cut
    together by one pass of the pattern over all of them: a word that begins with a
    blank begins a part."""

    def __init__(self, pattern: str, texts):
        self.split = regex.compile(pattern).findall
        regular, odd = _Numbers(), {}
        rows: list[np.ndarray] = []
        for value in texts:
            first, *parts = (value.as_py() or "").split(" ")
            own = np.fromiter(map(regular.__getitem__, parts), np.int64, len(parts))
            if (not first and parts) or first[-1:].isspace() or (len(own) and own.min() < 0):
                first, parts = self._clean(first, parts)
                own = np.fromiter((self._number(p, regular, odd) for p in parts), np.int64, len(parts))
            begin = odd.setdefault(first, len(odd))
            rows.append(np.concatenate(([-1 - begin], own)))
        n = len(regular.parts)
        self.rows = [np.where(r < 0, n - 1 - r, r) for r in rows]
        words = self.split(" " + " ".join(regular.parts)) if n else []
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != n:
            raise ValueError("the pattern joins a blank to what stands before it")
        sizes = np.diff([*starts, len(words)]).tolist() if n else []
        for part in odd:
            cut = self.split(part)
            words += cut
            sizes.append(len(cut))
        #: Words of each part: how many, and all of them in order, as numbers of ``words``.
        self.sizes = np.array(sizes, np.int64)
        known: dict[str, int] = {}
        self.of_parts = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        self.words = [w.encode("utf-8") for w in known]

    @staticmethod
    def _clean(first: str, parts: list[str]) -> tuple[str, list[str]]:
        """The text up to its first clean blank, and the parts (with their blank where
        that isn't the only one) from then on."""
        merged, open_end = [first], not first or first[-1].isspace()
        for part in parts:
            if open_end:
                merged[-1] += " " + part
            else:
                merged.append(part)
            open_end = not part or part[-1].isspace()
        return merged[0], merged[1:]

    @staticmethod
    def _number(part: str, regular: _Numbers, odd: dict[str, int]) -> int:
        number = -1 if " " in part else regular[part]
        return number if number >= 0 else -1 - odd.setdefault(" " + part, len(odd))

    def gather(self, row: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the items of a text's parts are, in order, given each part's number of
        items and where they start."""
        many = sizes[row]
        ends = np.cumsum(many)
        return np.repeat(starts[row] - ends + many, many) + np.arange(ends[-1])


_BETWEEN = b"\xff"  # is in no UTF-8 text
#: Words of more bytes are folded by a heap in Python.
MAX_FOLD = 256


def by_bucket(words: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Words sorted within their buckets."""
    dealt: dict[int, list[bytes]] = {}
    for word in words:
        dealt.setdefault(zlib.crc32(word) % buckets, []).append(word)
    for same in dealt.values():
        same.sort()
    return dealt


def bucket_count(total_bytes: int) -> int:
    """Buckets for a corpus: distinct words grow somewhat faster than the square root
    of its size, so a bucket's number of them changes little (some 100,000)."""
    return max(8, math.ceil(8 * math.sqrt(total_bytes / (24 << 20))))


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _block_words(pattern: str, buckets: int, text_at: int):
    def run(key, table):
        dealt = by_bucket(BlockWords(pattern, table.column(text_at)).words, buckets)
        packed = [_pack(_BETWEEN.join(same)) for same in dealt.values()]
        free_memory()
        return pa.table({"bucket": pa.array(dealt, pa.int32()), "block": pa.array([key[0].as_py()] * len(dealt), pa.int32()), "words": pa.array(packed, pa.binary())})

    return run


def _distinct_words(ranks: dict[bytes, int]):
    """Rows (bucket, block, words), sorted by bucket -> rows of a bucket's distinct words,
    and of each block's words as their numbers, after the words they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers = None, {}
        for batch in batches:
            for bucket, block, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    current, numbers = bucket, {}
                words = _unpack(packed).split(_BETWEEN)
                known = len(numbers)
                own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words))
                fresh = [w for w, n in zip(words, own.tolist()) if n >= known]
                long = [_merge_long_word(w, ranks) if len(w) > MAX_FOLD else None for w in fresh]
                n = len(fresh)
                columns = [
                    pa.array([bucket] * (n + 1), pa.int32()), pa.array([None] * n + [block], pa.int32()), pa.array([*fresh, None], pa.binary()),
                    pa.array([*long, None], pa.list_(pa.int32())), pa.array([None] * n + [_pack(own.tobytes())], pa.binary()),
                ]
                whole = pa.RecordBatch.from_arrays(columns, ["bucket", "block", "word", "known", "numbers"])
                for start in range(0, n + 1, 10_000):
                    yield whole.slice(start, 10_000)

    return run


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, numbers, ids) in that order -> (block, bucket, ids): of each
    block's words in a bucket how many ids each has, and the ids, packed."""
    current, pieces = None, []
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        buckets, blocks, numbers = (batch.column(i).to_pylist() for i in (0, 1, 2))
        column = batch.column(3)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<u4")
        for row, (bucket, block, packed) in enumerate(zip(buckets, blocks, numbers)):
            if bucket != current:
                current, pieces = bucket, []
            if packed is None:
                pieces.append(flat[offsets[row] : offsets[row + 1]])
                continue
            own = [pieces[n] for n in np.frombuffer(_unpack(packed), np.uint32).tolist()]
            counts = np.fromiter(map(len, own), "<u4", len(own))
            out[0].append(block)
            out[1].append(bucket)
            out[2].append(_pack(counts.tobytes() + (np.concatenate(own) if own else counts).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "bucket", "ids"])


def _word_ids(words: list[bytes], buckets: int, given: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all words in order, from the
    packed ids of the words of each bucket."""
    dealt = by_bucket(words, buckets)
    place = {w: i for i, w in enumerate(words)}
    order, counts, flat = [], [], []
    for bucket, packed in zip(given.column("bucket").to_pylist(), given.column("ids").to_pylist()):
        same, data = dealt.pop(bucket), np.frombuffer(_unpack(packed), "<u4")
        own = data[: len(same)].astype(np.int64)
        if own.sum() + len(same) != len(data):
            raise ValueError("a block's words and their ids don't match")
        order.append(np.fromiter(map(place.__getitem__, same), np.int64, len(same)))
        counts.append(own)
        flat.append(data[len(same) :])
    if dealt:
        raise ValueError("words without ids")
    if not order:
        return np.zeros(0, np.int64), np.zeros(0, "<u4")
    order, counts, flat = map(np.concatenate, (order, counts, flat))
    sizes = np.zeros(len(words), np.int64)
    sizes[order] = counts
    starts = np.zeros(len(words), np.int64)
    starts[order] = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    return sizes, flat[np.repeat(starts - ends + sizes, sizes) + np.arange(len(flat))]


def _encode_block(pieces: list[bytes], pattern: str, buckets: int, kept: list[str], text_at: int, digest: bool, schema: pa.Schema):
    def run(key, table, given):
        block = BlockWords(pattern, table.column(text_at))
        sizes, flat = _word_ids(block.words, buckets, given)
        # from ids by word to ids by part
        starts = np.cumsum(sizes) - sizes
        many = sizes[block.of_parts]
        ends = np.cumsum(many)
        flat = flat[np.repeat(starts[block.of_parts] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        of_part = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(block.sizes)))]
        sizes, starts = np.diff(of_part), of_part[:-1]
        # decoded from the ids, each distinct part once
        binary, bounds = list(map(pieces.__getitem__, flat.tolist())), of_part.tolist()
        texts = [b"".join(binary[i:j]) for i, j in zip(bounds, bounds[1:])]
        counts, ids_out, decoded_out = [], [], []
        for row in block.rows:
            ids = flat[block.gather(row, sizes, starts)]
            decoded = b"".join(map(texts.__getitem__, row.tolist()))
            counts.append(len(ids))
            ids_out.append(hashlib.sha256(ids).hexdigest() if digest else ids.astype("int32"))
            decoded_out.append(hashlib.sha256(decoded).hexdigest() if digest else decoded)
        columns = [table.column(1 + i) for i in range(len(kept))]
        made = [pa.array(c, schema.field(len(kept) + 1 + i).type) for i, c in enumerate((ids_out, decoded_out))]
        del block, flat, binary, texts, ids_out, decoded_out
        free_memory()
        return pa.Table.from_arrays([*columns, pa.array(counts, pa.int64()), *made], schema.names)

    return run


def encode_documents(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    digest: bool = False,
    block_bytes: int = 24 << 20,
) -> DataFrame:
    """Encode and decode ``text_col`` of every row.

    Returns ``id_col``, the columns of ``keep``, n_tokens long and either ids
    array<int> and decoded binary or, with ``digest``, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256. A column of
    ``keep`` that clashes with these must be renamed first (ValueError).
    """
    kept = list(dict.fromkeys([id_col, *(keep or [])]))
    clash = set(kept) & {"n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256", "_block"}
    if clash:
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks, buckets = total // block_bytes + 1, bucket_count(total)
    names = list(dict.fromkeys([*kept, text_col]))
    source = docs.select(*names)
    source = source.select(deal_of(source, blocks).alias("_block"), *names)
    made = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", n_tokens bigint, {made}"
    literals = RankLiterals(rank_path)
    text_at = 1 + names.index(text_col)

    words = source.groupBy("_block").applyInArrow(_block_words(pattern, buckets, text_at), "bucket int, block int, words binary")
    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    ranks = {piece: rank for rank, piece in enumerate(literals.pieces)}
    distinct = dealt.mapInArrow(lean(_distinct_words(ranks)), "bucket int, block int, word binary, known array<int>, numbers binary")
    fold = F.when(F.col("word").isNotNull(), F.coalesce("known", literals.bind(lambda t: encode_word(t, F.col("word")))))
    coded = distinct.select("bucket", "block", "numbers", fold.alias("ids"))
    block_ids = coded.mapInArrow(lean(_block_ids), "block int, bucket int, ids binary").withColumnRenamed("block", "_block")
    schema = to_arrow_schema(docs.select(*kept).withColumn("n_tokens", F.lit(0).cast("long")).selectExpr("*", *(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in made.split(", "))).schema)
    run = _encode_block(literals.pieces, pattern, buckets, kept, text_at, digest, schema)
    return source.groupBy("_block").cogroup(block_ids.groupBy("_block")).applyInArrow(run, result)
